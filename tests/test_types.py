"""Expressions whose operation depends on types: the same cases through the compiler to DataFrames and the evaluator."""

import math
import random

import pytest

from querylens.operators.schema import GraphSchema
from querylens.plans import empty_graph
from querylens.plans import syntax as S
from querylens.plans.frames import GraphSession, PropertyGraph, _Part, repeats_dont_count, turned

CASES = [
    ("RETURN 7 / 2 AS x", 3), ("RETURN -7 / 2 AS x", -3), ("WITH 7 AS a RETURN a / 2 AS x", 3), ("WITH 7.0 AS a RETURN a / 2 AS x", 3.5), ("WITH -7 AS a RETURN a % 3 AS x", -1), ("WITH 1 AS a, 0.0 AS b RETURN a / b AS x", math.inf),
    ("WITH 'a' AS s RETURN s + s AS x", "aa"), ("WITH 'a' AS s, 3 AS n RETURN s + '-' + n AS x", "a-3"), ("WITH 'a' AS s RETURN s + true AS x", "atrue"), ("WITH null AS s RETURN s + 'a' AS x", None),
    ("RETURN [1, 2] + [3] AS x", [1, 2, 3]), ("RETURN [1] + 2 AS x", [1, 2]), ("RETURN 0 + [1] AS x", [0, 1]), ("RETURN [] + [] AS x", []), ("RETURN [] + ['a'] AS x", ["a"]),
    ("UNWIND [1, 2, null] AS y WITH collect(y) AS xs RETURN size(xs) AS x", 2), ("WITH [1, 2] AS xs RETURN size(xs + xs) AS x", 4), ("WITH 'abc' AS s RETURN size(s) AS x", 3), ("WITH [[1], [2, 3]] AS xs RETURN size(xs[1]) AS x", 2),
    ("RETURN size([y IN ['ab', 'c'] | size(y)]) AS x", 2), ("RETURN [y IN ['ab', 'c'] | size(y)] AS x", [2, 1]), ("RETURN [y IN [1, 2, 3] WHERE y / 2 = 1 | y + 0.5] AS x", [2.5, 3.5]),
    ("RETURN 'a' = 1 AS x", False), ("RETURN 'a' <> 1 AS x", True), ("RETURN 1 = 1.0 AS x", True), ("RETURN null = 1 AS x", None), ("RETURN 'a' < 1 AS x", None), ("RETURN 1 < 1.5 AS x", True), ("RETURN [1] = [1] AS x", True),
    ("RETURN 1 IN ['a'] AS x", False), ("RETURN 2 IN [] AS x", False), ("WITH [1, 2] AS xs RETURN 2 IN xs AS x", True), ("WITH [1, null] AS xs RETURN 2 IN xs AS x", None), ("RETURN 1.0 IN [1, 2] AS x", True), ("RETURN 3 IN null AS x", None),
    ("RETURN range(1, 3) AS x", [1, 2, 3]), ("RETURN range(3, 1) AS x", []), ("RETURN range(3, 1, -1) AS x", [3, 2, 1]), ("RETURN size(range(1, 0)) AS x", 0), ("RETURN date('2020-03-05').year AS x", 2020),
    ("RETURN coalesce(null, 2) / 4 AS x", 0), ("RETURN CASE WHEN 1 > 2 THEN 1 ELSE 2.5 END AS x", 2.5), ("RETURN 1 STARTS WITH 'a' AS x", None), ("RETURN head([[1, 2]]) + [3] AS x", [1, 2, 3]), ("RETURN last([1, 2]) / 2 AS x", 1),
]
BAD = [
    "RETURN 'a' - 1", "RETURN 1 AND true", "RETURN true + 1", "RETURN [1] * 2", "RETURN 1 IN 2", "RETURN -'a'", "RETURN abs('x')", "RETURN 1 / 0", "RETURN sum('a')", "WITH 1 AS a RETURN a / 0",
]


@pytest.fixture(scope="module")
def session(spark):
    frame = spark.createDataFrame
    nodes = {"P": frame([(1, "ann", 30), (2, "bob", None), (3, "cy", 25)], "id long, name string, age int"), "C": frame([(1, "x")], "id long, name string")}
    return GraphSession(spark, PropertyGraph(nodes, {"KNOWS": [("P", "P", frame([(1, 2), (2, 3), (3, 1)], "src long, dst long"))], "LIVES": [("P", "C", frame([(1, 1), (3, 1)], "src long, dst long"))]}))


@pytest.mark.parametrize(("query", "want"), CASES)
def test_both_evaluators(session, query, want):
    got = session.run(query)
    assert got.success, got.error
    assert got.rows == [(want,)] and type(got.rows[0][0]) is type(want)
    assert [tuple(list(x) if isinstance(x, range) else x for x in r) for r in empty_graph.execute(query, GraphSchema())] == [(want,)]


@pytest.mark.parametrize("query", BAD)
def test_both_refuse(session, query):
    got = session.run(query)
    assert not got.success and got.error_kind == "runtime"
    with pytest.raises((S.QueryError, TypeError, ValueError)):
        empty_graph.execute(query, GraphSchema())


def test_only_query_errors(session):
    for query in [*BAD[:7], "RETURN NOT 3", "WITH 1 AS a WHERE a + 1 RETURN a", "MATCH (p:P) RETURN p.name - 1", "MATCH (p:P) RETURN p + 1", "MATCH (p:P) RETURN nodes(p)", "MATCH (p:P) RETURN size(p.age)", "UNWIND [1, 'a'] AS x RETURN x"]:
        with pytest.raises(S.QueryError):
            session.execute(query)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("UNWIND null AS x RETURN x", []),
        ("UNWIND 5 AS x RETURN x", [(5,)]),
        ("MATCH (p:P) UNWIND [p.id, p.age] AS x RETURN count(x) AS n, count(*) AS m", [(5, 6)]),
        ("MATCH (p:P) RETURN p.age / 4 AS a ORDER BY a", [(6,), (7,), (None,)]),
        ("MATCH (p:P) RETURN p.name + p.name AS a ORDER BY a LIMIT 1", [("annann",)]),
        ("MATCH p = (a:P {id: 1})-[:KNOWS*1..3]->(b) RETURN length(p) AS n, [x IN nodes(p) | x.id] AS ids ORDER BY n", [(1, [1, 2]), (2, [1, 2, 3]), (3, [1, 2, 3, 1])]),
        ("MATCH p = (a:P {id: 1})-[:KNOWS]->(b)-[:LIVES]->(c) RETURN length(p)", []),
        ("MATCH p = (a:P)-[:KNOWS]->(b)-[:LIVES]->(c) RETURN length(p), size(nodes(p)), size(relationships(p)), a.id ORDER BY a.id", [(2, 3, 2, 2), (2, 3, 2, 3)]),
        ("MATCH p = (a:P {id: 1}) RETURN length(p)", [(0,)]),
        ("MATCH (a:P) OPTIONAL MATCH p = (a)-[:LIVES]->(c) RETURN a.id, length(p) ORDER BY a.id", [(1, 1), (2, None), (3, 1)]),
        ("MATCH p = (a:P {id: 3})-[:KNOWS]->(b) WITH p AS q, b MATCH (b)-[:LIVES]->(c) RETURN length(q), c.name", [(1, "x")]),
    ],
)
def test_lists_and_paths(session, query, want):
    got = session.run(query)
    assert got.success, got.error
    assert got.rows == want


def test_reachability_takes_each_pair_once(spark):
    n = 400  # two rings, one hanging from the other
    pairs = [(i, (i + 1) % n) for i in range(n)] + [(1000 + i, 1000 + (i + 1) % 30) for i in range(30)] + [(7, 1003), (0, 0)]
    ids = sorted({x for p in pairs for x in p})
    graph = PropertyGraph({"P": spark.createDataFrame([(i,) for i in ids], "id long")}, {"N": [("P", "P", spark.createDataFrame(pairs, "src long, dst long"))]})
    session = GraphSession(spark, graph)
    assert session.run("MATCH (a:P {id: 1010})-[:N*]->(b) RETURN count(DISTINCT b.id) AS n").rows == [(30,)]
    assert session.run("MATCH (a:P {id: 1010})-[:N*0..]->(b) RETURN count(DISTINCT b) AS n").rows == [(30,)]
    assert session.run("MATCH (a:P {id: 1010})-[:N*..4]->(b) RETURN DISTINCT b.id AS x ORDER BY x").rows == [(1011,), (1012,), (1013,), (1014,)]
    assert session.run("MATCH (a:P {id: 5})<-[:N*1..3]-(b) RETURN DISTINCT b.id AS x ORDER BY x").rows == [(2,), (3,), (4,)]
    assert session.run("MATCH (a:P) WHERE a.id > 990 AND EXISTS { (a)-[:N*]->(:P {id: 3}) } RETURN count(*) AS n").rows == [(0,)]
    # each path counts where repeats do
    assert session.run("MATCH (a:P {id: 1010})-[:N*1..2]->(b) RETURN count(*) AS n").rows == [(2,)]


def test_what_many_seeds_reach_alike_is_held_once(spark):
    rng = random.Random(3)
    pairs = [(i, (i * 7 + 1) % 20) for i in range(20)] + [(rng.randrange(24), rng.randrange(28)) for _ in range(30)]  # a knot, what leads to it and what hangs from it
    pairs += [(100, 101), (101, 100), (101, 102), (103, 3), (103, 104), (104, 104)]
    ids = sorted({x for p in pairs for x in p} | {300})
    graph = PropertyGraph({"P": spark.createDataFrame([(i, i % 7) for i in ids], "id long, k long")}, {"N": [("P", "P", spark.createDataFrame(pairs, "src long, dst long"))]})
    session = GraphSession(spark, graph)

    def reached(a, edges):
        seen, new = set(), {d for s, d in edges if s == a}
        while new:
            seen |= new
            new = {d for s, d in edges if s in new} - seen
        return seen

    want = {(a, b) for a in ids if a % 7 > 1 for b in reached(a, pairs)}
    frame = session.execute("MATCH (a:P)-[:N*]->(b:P) WHERE a.k > 1 RETURN DISTINCT a.id AS a, b.id AS b")
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "Aggregate" not in plan
    rows = session.execute("MATCH (a:P)-[:N*0..]->(b:P) WHERE a.k > 1 RETURN DISTINCT a.id AS a, b.id AS b").collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == want | {(a, a) for a in ids if a % 7 > 1}


def test_what_makes_repeats_count():
    flags = lambda q: repeats_dont_count(S.parse(q).parts[0])
    assert flags("MATCH (a) RETURN DISTINCT a") == [True, True] and flags("MATCH (a) RETURN a") == [False, False]
    assert flags("MATCH (a) UNWIND [1] AS x MATCH (b) RETURN count(DISTINCT a), max(x)") == [True] * 4
    assert flags("MATCH (a) RETURN count(a)")[0] is False and flags("MATCH (a) RETURN DISTINCT a, count(*)")[0] is False
    assert flags("MATCH (a) WITH DISTINCT a MATCH (b) RETURN a, b") == [True, True, False, False]


def test_patterns_start_at_their_best_node(session):
    def shape(text, kinds=()):
        part = _Part(session)
        part.named = {}
        match = S.parse(text + " RETURN 1 AS x").parts[0][0]
        return [[(n.var, bool(n.labels)) for n in p.nodes] + [r.direction for r in p.rels] for p in part.anchored(match.paths, match.where, dict.fromkeys(kinds, "node"))]

    assert shape("MATCH (a:P)-[:KNOWS]->(b:P)") == [[("a", True), ("b", True), "out"]]
    assert shape("MATCH (a:P)-[:KNOWS]->(b:P {id: 3})") == [[("b", True), ("a", True), "in"]]
    assert shape("MATCH (a:P)-[:KNOWS]->(b:P)<-[:LIVES]-(c) WHERE b.name = 'x'") == [[("b", True), ("c", False), "in"], [("b", False), ("a", True), "in"]]
    assert shape("MATCH (a:P)-[:KNOWS]->(b:P)", ["b"]) == [[("b", True), ("a", True), "in"]]
    path = S.parse("MATCH (a)-[r:KNOWS*1..2]->(b)-[:LIVES]-(c) RETURN 1 AS x").parts[0][0].paths[0]
    assert turned(turned(path)) == path


def test_rows_are_counted_once(session):
    session.counts.clear()
    assert session.rows_of(["P"]) == 3 and session.rows_of([]) == 4 and session.rows_of(["none"]) == 0 and len(session.counts) == 2
