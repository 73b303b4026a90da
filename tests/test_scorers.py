import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylens.functions import text as X
from querylens.operators import judge, pattern
from querylens.operators.schema import TRIVIAL_DDL, compile_schema


def column(spark, values, f, *more):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    names = ["i", *(f"c{k}" for k in range(len(rows[0]) - 1))]
    d = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'i' else 'string'}" for n in names))
    return [r[0] for r in d.orderBy("i").select(f(*[F.col(n) for n in names[1:]])).collect()]


def test_extraction(spark):
    fence = "```"
    texts = [
        f"{fence}cypher\nMATCH (n) RETURN n\n{fence}", "Here is the query with joins: MATCH (n) RETURN n", f"{fence}\nUNWIND [1] AS x RETURN x\n{fence}", f"{fence}sql\nMATCH (n) RETURN n\n{fence}",
        f"{fence}A{fence} {fence}B{fence}", "optional match (a) return a", "  no keyword here ", None, "", "<think>hmm</think> MATCH (n) RETURN n", "  x  ",
    ]
    want = ["MATCH (n) RETURN n", "with joins: MATCH (n) RETURN n", "UNWIND [1] AS x RETURN x", "sql\nMATCH (n) RETURN n", "A", "optional match (a) return a", "no keyword here", "", "", "MATCH (n) RETURN n", "x"]
    assert column(spark, texts, X.extract_query) == want
    twice = column(spark, texts, lambda c: X.extract_query(X.extract_query(c)))
    assert twice[2:4] == ["RETURN x", "MATCH (n) RETURN n"]


def test_exact_match(spark):
    assert column(spark, ["MATCH  (n)\nRETURN n ;", "a; ;", None, "  "], X.normalize_query) == ["match (n) return n", "a;", "", ""]
    assert column(spark, [("A b;", "a  B"), ("", None), ("a", "b")], X.exact_match) == [1, 1, 0]


def brute_bleu(gold, pred):
    r, h = gold.split(), pred.split()
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hits = [sum((grams(h, n) & grams(r, n)).values()) for n in range(1, 5)]
    if not h or not hits[0]:
        return 0.0
    logs = sum(math.log((m or 0.1) / max(1, len(h) - n + 1)) for n, m in enumerate(hits, 1))
    return (1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(logs / 4)


def test_bleu(spark):
    g = "MATCH (n:P) RETURN n.name"
    cases = [(g, g), (g, "match (n:p) return n.name;"), ("MATCH (a:X) RETURN a.name LIMIT 5", "MATCH (a:X) RETURN a.name"), ("RETURN 1", "RETURN 1"), ("MATCH (n:P) RETURN n", "MATCH (m:P) RETURN m"), ("MATCH (n) RETURN n", "")]
    want = [1.0, 0.0, 0.6065306597126334, 0.316227766016838, 0.09554427922043669, 0.0]
    assert column(spark, cases, X.bleu4) == pytest.approx(want, abs=1e-12)
    mixed = [("a b a b c", "a b a b a b"), ("x", "x y z w v"), ("a a a a a", "a a a"), ("one two three four five six", "two three four six five one")]
    assert column(spark, mixed, X.bleu4) == pytest.approx([brute_bleu(*c) for c in mixed], abs=1e-12)


def test_penalty_prompt_and_pieces(spark):
    got = column(spark, ["0", "256", "320", "384", "512", "1000", None], lambda c: X.length_penalty(c.cast("int")))
    assert got == [0, 0, -0.125, -0.25, -0.5, -0.5, 0]
    assert column(spark, [("S {question}", "Q")], X.prompt)[0] == X.PROMPT.replace("{question}", "Q").replace("{schema}", "S {question}")
    texts = ["a,(b,c),[d,{e,f}],g", "", "x,", "),a", None]
    assert column(spark, texts, X.top_level_pieces) == [pattern.top_level_pieces(t or "") for t in texts]
    assert pattern.top_level_pieces(texts[0]) == ["a", "(b,c)", "[d,{e,f}]", "g"]


def test_string_ratio():
    assert pattern.string_ratio("diet", "tide") == 0.25 and pattern.string_ratio("tide", "diet") == 0.5
    assert pattern.string_ratio("match (n:p) return n.name;", "MATCH (n:P) RETURN n.name") == pytest.approx(0.5098039215686274)
    gold = "MATCH (n:Label) WHERE n.a = 1 RETURN n " * 6
    assert pattern.string_ratio(gold.replace("WHERE", "where"), gold) == pytest.approx(0.06866952789699571)
    assert pattern.string_ratio("", "x") == pattern.string_ratio("x", None) == 0


U = pattern.UNLABELED


@pytest.mark.parametrize(
    ("query", "labels", "edges"),
    [
        ("MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN a", ("Person", "Person"), ((0, 1, "KNOWS"),)),
        ("MATCH (a:Person)<-[:KNOWS]-(b:Person) RETURN a", ("Person", "Person"), ((0, 1, "KNOWS"), (1, 0, "KNOWS"))),
        ("CREATE (a:X)", (), ()),
        ("CREATE (a:X) RETURN a", ("X",), ()),
        ("MATCH (a:X)-->(b:Y)-[:R]->(c:Z) RETURN c", ("X", "Y", "Z"), ((0, 1, "R"),)),
        ("MATCH (s:Set)-[:R]->(b) RETURN b", (), ()),
        ("MATCH (a) MATCH (a:X) RETURN a", (U,), ()),
        ("MATCH (a:A|B)-[:R|S*1..3]->(b) RETURN b", ("A", U), ((0, 1, "R"),)),
        ("MATCH (a:X), (b:Y) WHERE a.s = '(c:Z)' RETURN a", ("X", "Y"), ()),
        ("MATCH (a:A:B) RETURN a", (), ()),
        ("RETURN 1", (), ()),
        (None, (), ()),
    ],
)
def test_pattern_graphs(query, labels, edges):
    assert pattern.pattern_graph(query) == (labels, edges)


def test_edit_distance_scores():
    q = "MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN a"
    assert pattern.ged_score(q, q) == (1, True)
    assert pattern.ged_score(q, q.replace("b:Person", "b:City")) == (pytest.approx(2 / 3), True)
    assert pattern.ged_score("RETURN 1", q) == pattern.ged_score(None, q) == (0, True)
    other = q.replace("(b:Person)", "(b:City)-[:IN]->(c:Land)")
    assert pattern.ged_score(q, other, 1)[1] is False and pattern.ged_score(q, other, None) == (pytest.approx(0.4), True)
    long = "MATCH " + ", ".join(f"(n{i}:L{i % 4})" for i in range(21)) + " RETURN 1"
    assert pattern.ged_score(long, "MATCH (a:L0), (b:Z) RETURN a") == (0.25, True)


def brute_distance(a, b):
    from itertools import permutations

    (la, ea), (lb, eb) = a, b
    best = 10**9
    slots = [*range(len(lb)), *[None] * len(la)]
    for m in set(permutations(slots, len(la))):
        cost = sum(1 if j is None else la[i] != lb[j] for i, j in enumerate(m)) + len(lb) - sum(j is not None for j in m)
        mapped = {}
        for s, d, t in ea:
            mapped.setdefault((m[s], m[d]), Counter())[t] += 1
        gold = {}
        for s, d, t in eb:
            gold.setdefault((s, d), Counter())[t] += 1
        for k in {*mapped, *gold}:
            x, y = mapped.get(k, Counter()), gold.get(k, Counter())
            cost += x.total() if None in k else max(x.total(), y.total()) - (x & y).total()
        best = min(best, cost)
    return best


graphs = st.integers(0, 3).flatmap(
    lambda n: st.tuples(st.lists(st.sampled_from("AB"), min_size=n, max_size=n).map(tuple), st.lists(st.tuples(st.integers(0, max(n - 1, 0)), st.integers(0, max(n - 1, 0)), st.sampled_from("RS")), max_size=4 if n else 0).map(tuple))
)


@settings(max_examples=150, deadline=None)
@given(graphs, graphs)
def test_edit_distance_is_exact(a, b):
    want = brute_distance(a, b)
    assert pattern.edit_distance(a, b) == pattern.edit_distance(b, a) == (want, True)
    assert pattern.edit_distance(a, a) == (0, True)
    cut, exact = pattern.edit_distance(a, b, 2)
    assert cut >= want and (cut == want or not exact)


A = "Node properties:\n- **Product**\n  - `productName`: STRING\n  - `unitPrice`: FLOAT\nRelationships:\n(:Product)-[:PART_OF]->(:Category)"
C = "Author {author_id: STRING}\nPUBLISHED_IN {pages: STRING}\n{'start': Article, 'type': PUBLISHED_IN, 'end': Journal}"
BOLD = "Node properties:\n- **Person**\n  - `name`: STRING\nRelationship properties:\n- **ACTED_IN**\n  - `roles`: LIST\nThe relationships:\n(:Person)-[:ACTED_IN]->(:Movie)"


def ddl(*nodes, rels=()):
    return "\n".join([*(f"CREATE NODE TABLE {n.split(' ')[0]}(id INT64, {''.join(p + ', ' for p in n.split(' ', 1)[1].split(', ') if p)}PRIMARY KEY (id));" for n in nodes), *(f"CREATE REL TABLE {r});" for r in rels)])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (A, ddl("Category ", "Product productName STRING, unitPrice DOUBLE", rels=["PART_OF(FROM Product TO Category"])),
        ('{"ASSIGNED_TO":{"count":27,"type":"relationship"},"Task":{"type":"node","properties":{"due":{"type":"DATE"}}}}', ddl("Any ", "Task due DATE", rels=["ASSIGNED_TO(FROM Any TO Any"])),
        ('{"R":{"type":"relationship","from":["A"],"start":["B","C"],"to":["D"]}}', ddl("B ", "D ", rels=["R(FROM B TO D"])),
        (C, ddl("Article ", "Author author_id STRING", "Journal ", rels=["PUBLISHED_IN(FROM Article TO Journal, pages STRING"])),
        (None, TRIVIAL_DDL),
        ("hello", TRIVIAL_DDL),
        ("- **User**\n  - `id`: STRING", ddl("User id STRING")),
        (BOLD, ddl("ACTED_IN roles STRING", "Movie ", "Person name STRING", rels=["ACTED_IN(FROM Person TO Movie"])),
        ("(:A)-[:R]-(:B)", ddl("A ", "B ", rels=["R(FROM A TO B"])),
        ("(:A)<-[:R]-(:B)", TRIVIAL_DDL),
        ("(:A)-[:R]->(:B)\n(:A)-[:R]->(:B)\n(:A)-[:R]->(:C)", ddl("A ", "B ", "C ", rels=["R(FROM A TO B", "R(FROM A TO C"])),
        ("**E** `t`: DATE_TIME", ddl("E t DATE")),
        ("E {t: DATE_TIME}", ddl("E t STRING")),
        ('{"A":{"type":"node","properties":["x"]}}', ddl("A ")),
    ],
)
def test_schema_compiler(text, want):
    assert compile_schema(text) == want


S = "- **A**\n - `x`: INTEGER\n- **B**\n - `y`: STRING\n(:A)-[:R]->(:B)"


@pytest.mark.parametrize(
    ("pred", "gold", "grade"),
    [
        ("", "MATCH (a:A) RETURN a", 0.0),
        ("MATCH (a:A RETURN a", "MATCH (a:A) RETURN a", 0.0),
        ("MATCH (a:Nope) RETURN a", "MATCH (a:A) RETURN a", 0.3),
        ("MATCH (a:A) RETURN a.nope", "MATCH (a:A) RETURN a", 0.3),
        ("CALL db.labels()", "MATCH (a:A) RETURN a", 0.3),
        ("MATCH (a:A) RETURN foo(a)", "MATCH (a:A) RETURN a", 0.3),
        ("MATCH (a:A) RETURN b", "MATCH (a:A) RETURN a", 0.3),
        ("MATCH (a:A) RETURN a", "not a query", 0.7),
        ("MATCH (a:A) RETURN a", "MATCH (b:B) RETURN b", 1.0),
        ("MATCH (a:A) RETURN count(a)", "MATCH (a:A) RETURN a", 0.7),
        ("MATCH (a:A) RETURN a.x, count(*) AS n", "MATCH (a:A) RETURN a", 1.0),
        ("UNWIND [2, 1, 1] AS x RETURN x", "UNWIND [1.0, 2] AS y RETURN y AS z ORDER BY z DESC", 1.0),
        ("OPTIONAL MATCH (a:A) RETURN a.x", "RETURN null", 1.0),
        ("RETURN 1, 2", "RETURN 2, 1", 0.7),
        ("RETURN {b: 1, a: 2}", "RETURN {a: 2, b: 1}", 1.0),
        ("RETURN 1 UNION RETURN true", "RETURN 1.0", 1.0),
        ("MATCH (a:A) WITH a, count(*) AS n WHERE n > 1 RETURN n UNION ALL RETURN 5", "RETURN 2 + 3", 1.0),
        ("RETURN CASE WHEN null THEN 1 ELSE [x IN range(1, 4) WHERE x % 2 = 0 | x * x] END", "RETURN [4, 16]", 1.0),
        ("RETURN 1 / 0", "RETURN 1", 0.3),
        ("CREATE (a:A {x: 3}) RETURN a.x", "RETURN 3", 1.0),
    ],
)
def test_judge(pred, gold, grade):
    assert judge.judge_one(pred, gold, S) == grade


def test_schemaless_backend_is_lenient():
    assert judge.get_backend(" Schemaless ") == "schemaless"
    assert judge.judge_one("MATCH (a:Nope) RETURN a.q", "MATCH (z:Q) RETURN z", S, "schemaless") == 1.0
    with pytest.raises(ValueError):
        judge.get_backend("other")
    assert judge.execute(S, "MATCH (a:" + "x" * 999)[2][:300] == judge.execute(S, "MATCH (a:" + "x" * 999)[2]


def test_missing_columns_and_nulls(spark):
    d = spark.createDataFrame([(1, "RETURN 1", "RETURN 1", None), (2, None, None, S)], "i long, completion string, cypher string, schema string")
    got = {r.i: r for r in judge.composite(d).collect()}
    assert got[1].r_judge == 1.0 and got[1].reward == 2.0 and got[2].reward == 0.0
    assert {r.reward for r in judge.composite(d.drop("cypher", "schema")).collect()} == {0.0}
