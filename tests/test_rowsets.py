import datetime
import decimal
import random

import pytest

from querylens.operators.graph_judge import GraphJudge, tables_read
from querylens.operators.rowsets import fingerprint, same_rows
from querylens.plans import syntax as S
from querylens.plans.frames import GraphSession, PropertyGraph


def equal(a, b, as_set=True):
    return same_rows(a, b, as_set).first().equal


VALUES = [
    ("1", "int", "1.0", "double", True), ("1", "int", "true", "boolean", True), ("0", "int", "false", "boolean", True), ("0.0", "double", "-0.0", "double", True), ("1", "int", "'1'", "string", False), ("2.50", "decimal(5,2)", "2.5", "double", True),
    ("9007199254740993", "bigint", "9007199254740992", "double", False), ("9007199254740992", "bigint", "9007199254740992", "double", True), ("1e300", "double", "1e300", "double", True), ("1e300", "double", "1e299", "double", False), ("1e20", "double", "100000000000000000000", "decimal(38,0)", True),
    ("'nan'", "double", "'NaN'", "float", True), ("'inf'", "double", "'-inf'", "double", False), ("null", "int", "null", "string", True), ("null", "int", "0", "int", False), ("''", "string", "null", "string", False), ("date '2020-01-02'", "date", "'2020-01-02'", "string", True),
    ("array(1, 2)", "array<int>", "array(1.0, 2.0)", "array<double>", True), ("array(1, 2)", "array<int>", "array(2, 1)", "array<int>", False), ("array('a', 'b')", "array<string>", "array('ab')", "array<string>", False), ("array(1, null)", "array<int>", "array(1)", "array<int>", False),
    ("array('1:a')", "array<string>", "array('1', 'a')", "array<string>", False), ("named_struct('a', 1, 'b', 'x')", "struct<a:int,b:string>", "named_struct('c', 1, 'd', 'x')", "struct<c:int,d:string>", True), ("map('a', 1, 'b', 2)", "map<string,int>", "map('b', 2, 'a', 1)", "map<string,int>", True),
]


@pytest.mark.parametrize(("a", "a_type", "b", "b_type", "want"), VALUES)
def test_values(spark, a, a_type, b, b_type, want):
    one = lambda x, t: spark.sql(f"SELECT CAST({x} AS {t}) AS v" if not t.startswith(("array", "struct", "map")) else f"SELECT {x} AS v")
    assert equal(one(a, a_type), one(b, b_type)) is want


def test_rows_as_sets_and_as_bags(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 9), rng.choice(["a", None, "b c", ""]), rng.choice([None, 0.5, float("nan")])) for _ in range(300)]
    make = lambda r: spark.createDataFrame(r, "x int, y string, z double").repartition(3)
    a, b = make(rows), make(rng.sample(rows, len(rows)))
    assert equal(a, b) and equal(a, b, False) and equal(a, a.distinct()) and not equal(a, a.distinct(), False)
    assert not equal(a, make(rows[1:] + [(10, "a", None)])) and not equal(a, make(rows + rows[:1]), False) and equal(a, make(rows + rows[:1]))
    assert not equal(a, a.select("y", "x", "z")) and equal(a, a.toDF("p", "q", "r")) and equal(a.limit(0), a.select("x").limit(0)) and not equal(a, a.limit(0))
    twice = a.select("x", a.x.alias("x"))  # columns of one name
    assert equal(twice, a.selectExpr("x", "x AS x2"))
    assert fingerprint(a.limit(0)).first().n == 0


def test_sums_of_many_rows_stay_in_their_words(spark):
    got = fingerprint(spark.range(20000)).first()
    assert got.n == 20000 and 0 <= got.high < 2**64 and 0 <= got.low < 2**64
    assert not equal(spark.range(20000), spark.range(1, 20001))
    assert got.high != decimal.Decimal(0) and datetime is not None


@pytest.fixture
def judge(spark):
    frame = spark.createDataFrame
    nodes = {"P": frame([(i, f"n{i}", i * 10) for i in range(6)], "id long, name string, age long")}
    edges = frame([(i, (i + 1) % 6) for i in range(6)] + [(0, 3)], "src long, dst long")
    return GraphJudge(GraphSession(spark, PropertyGraph(nodes, {"K": [("P", "P", edges)]})), timeout_s=60, batch=3)


def test_grades_on_rows(spark, judge):
    gold = "MATCH (a:P)-[:K]->(b:P) RETURN a.name, count(b) AS n"
    cases = [
        (gold, 1.0), ("MATCH (b:P)<-[:K]-(a:P) RETURN a.name AS x, 1.0 * count(*) AS y ORDER BY y", 1.0), ("MATCH (a:P)-[:K]->(b:P) WHERE a.age > 0 RETURN a.name, count(b)", 0.7), ("MATCH (a:P)-[:K]->(b:P) RETURN count(b), a.name", 0.7),
        ("MATCH (a:P) RETURN a.name, a.id / 0", 0.3), ("MATCH (a:Q) RETURN a", 0.3), ("MATCH (a:P RETURN", 0.0), ("", 0.0), (None, 0.0), ("CALL x()", 0.3), ("MATCH (a:P) SET a.age = 1", 0.7), ("MATCH (a:P {id: 0})-[:K*]->(b) RETURN b.name, count(*)", 0.7),
    ]
    rows = spark.createDataFrame([(k, p, gold, "e", "e") for k, (p, _) in enumerate(cases)] + [(99, gold, gold, "e", "e"), (100, gold, None, "e", "e"), (101, gold, "MATCH (", "e", "e")], "k long, pred string, cypher string, text string, n string")
    got = {r.k: r.grade for r in judge.grade(rows).collect()}
    assert got == {**{k: g for k, (_, g) in enumerate(cases)}, 99: 1.0, 100: 0.7, 101: 0.7}
    assert judge.session.run("MATCH (a:P) RETURN sum(a.age) AS s").rows == [(150,)]  # updates touched a copy
    assert judge.grade(rows.limit(0)).count() == 0


def test_late_queries_are_late_alone(spark, judge):
    slow = "UNWIND range(1, 3000) AS a UNWIND range(1, 3000) AS b UNWIND range(1, 3000) AS c RETURN count(*) AS n"
    judge.timeout_s = 6
    got = {text: kind for text, _, kind, *_ in judge.outcomes([slow, "MATCH (a:P) RETURN a.id"])}
    assert got == {slow: "timeout", "MATCH (a:P) RETURN a.id": None}


def test_tables_that_a_query_reads(judge):
    read = lambda q: tables_read(S.parse(q), judge.session.graph)
    assert read("MATCH (a:P)-[:K]->(b) RETURN a") == {"P", "K"} and read("RETURN 1 AS x") == set()
    assert read("RETURN EXISTS { (:P)-[:K]->() } AS x") == {"P", "K"} and read("MATCH ()-[r]->() RETURN r") == {"P", "K"}
