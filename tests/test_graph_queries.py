import pytest

from querylens.plans import syntax as S
from querylens.plans.frames import GraphSession, PropertyGraph, _Part


@pytest.fixture
def session(spark):
    frame = spark.createDataFrame
    return GraphSession(
        spark,
        PropertyGraph(
            {"P": frame([(1, "ann", 30), (2, "bob", None), (3, "cy", 25)], "id long, name string, age int"), "C": frame([(1, "x"), (2, "y")], "id long, name string")},
            {"KNOWS": [("P", "P", frame([(1, 2), (2, 3), (3, 1), (1, 1)], "src long, dst long"))], "LIVES": [("P", "C", frame([(1, 1, 2001), (2, 1, 2005)], "src long, dst long, since int"))]},
        ),
    )


CASES = [
    ("MATCH (p:P) RETURN p.name ORDER BY p.age", [("cy",), ("ann",), ("bob",)]),
    ("MATCH (p:P) RETURN p.name ORDER BY p.age DESC LIMIT 1", [("bob",)]),
    ("MATCH (a:P)-[:KNOWS]->(b:P) WHERE a.id <> b.id RETURN a.id, b.id ORDER BY a.id", [(1, 2), (2, 3), (3, 1)]),
    ("MATCH (a:P {id: 1})-[:KNOWS]-(b) RETURN b.id ORDER BY b.id", [(1,), (2,), (3,)]),
    ("MATCH (a:P)-[:KNOWS]->(b)-[:KNOWS]->(c) WHERE a.id = 1 RETURN b.id, c.id ORDER BY b.id, c.id", [(1, 2), (2, 3)]),
    ("MATCH (a:P {id: 1})-[:KNOWS*2..3]->(c) RETURN c.id, count(*) AS n ORDER BY c.id", [(1, 1), (2, 1), (3, 2)]),
    ("MATCH (p:P) OPTIONAL MATCH (p)-[l:LIVES]->(c:C) RETURN p.id, c.name, l.since ORDER BY p.id", [(1, "x", 2001), (2, "x", 2005), (3, None, None)]),
    ("MATCH (p:P) WHERE NOT EXISTS { (p)-[:LIVES]->(:C) } RETURN p.name", [("cy",)]),
    ("MATCH (p:P) WHERE (p)-[:LIVES]->() AND p.age IS NULL RETURN p.name", [("bob",)]),
    ("MATCH (n) RETURN label(n) AS l, count(*) AS k ORDER BY l", [("C", 2), ("P", 3)]),
    ("MATCH (a:P)-[r:KNOWS|LIVES]->(b) RETURN type(r) AS t, count(*) AS k ORDER BY t", [("KNOWS", 4), ("LIVES", 2)]),
    ("MATCH (p:P) WITH p.age > 26 AS old, collect(p.name) AS names WHERE old RETURN names", [(["ann"],)]),
    ("MATCH (p:P) WITH p AS q MATCH (q)-[:LIVES]->(c) RETURN q.name, c.name ORDER BY q.name", [("ann", "x"), ("bob", "x")]),
    ("UNWIND [1, null, 3] AS x RETURN sum(x) AS s, count(x) AS n, count(*) AS m", [(4, 2, 3)]),
    ("MATCH (p:P) RETURN avg(p.age) AS a, max(p.name) AS m", [(27.5, "cy")]),
    ("MATCH (c:C {name: 'none'}) RETURN count(c) AS n", [(0,)]),
    ("MATCH (p:P) RETURN p.id AS id UNION MATCH (c:C) RETURN c.id AS id", [(1,), (2,), (3,)]),
    ("MATCH (p:P)-[l:LIVES {since: 2005}]->(c) RETURN p.name", [("bob",)]),
    ("MATCH (p:P:C) RETURN p.id", []),
]


@pytest.mark.parametrize(("query", "want"), CASES)
def test_reads(session, query, want):
    got = session.run(query)
    assert got.success, got.error
    assert (got.rows if "ORDER" in query else sorted(got.rows, key=repr)) == want


def test_updates(session):
    run = lambda q: session.run(q).rows
    session.execute("CREATE (p:P {id: 9, name: 'dee'})-[:LIVES {since: 2020}]->(c:C {id: 7, name: 'z'})")
    assert run("MATCH (p:P)-[l:LIVES]->(c {name: 'z'}) RETURN p.name, l.since") == [("dee", 2020)]
    assert run("MATCH (p:P {id: 9}) SET p.age = 50 RETURN p.age") == [(50,)]
    session.execute("MATCH (p:P {id: 9}) REMOVE p.age")
    assert run("MATCH (p:P {id: 9}) RETURN p.age") == [(None,)]
    session.execute("MERGE (c:C {name: 'z'})")
    session.execute("MERGE (c:C {name: 'new'})")
    assert run("MATCH (c:C) RETURN count(*) AS n") == [(4,)]
    session.execute("FOREACH (x IN [100, 101] | CREATE (:C {id: x}))")
    session.execute("MATCH (c:C {name: 'z'}) DETACH DELETE c")
    assert run("MATCH (c:C) RETURN count(*) AS n") == [(5,)] and run("MATCH (:P)-[:LIVES]->(c) RETURN count(*) AS n") == [(2,)]


def test_errors(session):
    assert session.run("MATCH (p:P RETURN p").error_kind == "parse" and session.run("MATCH (p:Q) RETURN p").error_kind == "runtime"
    assert session.run("MATCH (p:P) RETURN p.nope").grade() == 0.3
    lenient = GraphSession(session.spark, session.graph, "schemaless")
    assert lenient.run("MATCH (p:Q) RETURN p.nope").rows == [] and lenient.run("MATCH (p:C) RETURN p.nope LIMIT 1").rows == [(None,)]


def test_timeout(session):
    slow = "UNWIND range(1, 3000) AS a UNWIND range(1, 3000) AS b UNWIND range(1, 3000) AS c RETURN count(*) AS n"
    assert session.run(slow, timeout_s=2).error_kind == "timeout"


@pytest.fixture
def chain(spark):
    """Twelve nodes in a row, and a cycle of three beside it."""
    frame = spark.createDataFrame
    pairs = [(i, i + 1) for i in range(1, 12)] + [(20, 21), (21, 22), (22, 20)]
    ids = sorted({x for p in pairs for x in p})
    return GraphSession(spark, PropertyGraph({"P": frame([(i,) for i in ids], "id long"), "C": frame([], "id long, name string")}, {"NEXT": [("P", "P", frame(pairs, "src long, dst long"))]}))


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (a:P {id: 1})-[:NEXT*]->(b) RETURN count(*) AS n", 11),
        ("MATCH (a:P)-[:NEXT*]->(b) WHERE a.id = 1 RETURN count(*) AS n", 11),
        ("MATCH (a:P {id: 1})-[:NEXT*10..]->(b) RETURN count(*) AS n", 2),
        ("MATCH (a:P {id: 1})-[:NEXT*0..]->(b) RETURN count(*) AS n", 12),
        ("MATCH (a:P {id: 20})-[:NEXT*]->(b) RETURN count(*) AS n", 3),
        ("MATCH (a:P {id: 12})<-[:NEXT*..20]-(b) RETURN count(*) AS n", 11),
        ("MATCH (a:P {id: 6})-[:NEXT*]-(b) RETURN count(*) AS n", 11),
        ("MATCH (a:P) WHERE a.id < 3 AND EXISTS { (a)-[:NEXT*9..]->(:P {id: 11}) } RETURN count(*) AS n", 2),
    ],
)
def test_paths_of_any_length(chain, query, want):
    got = chain.run(query)
    assert got.success and got.rows == [(want,)], got


def test_paths_stop_where_labels_do(session):
    part = [S.Rel(None, ["LIVES"], "out"), S.Rel(None, ["KNOWS", "LIVES"], "out"), S.Rel(None, ["LIVES"], "both"), S.Rel(None, ["none"], "both")]
    assert [_Part(session).most_hops(r) for r in part] == [1, None, None, 0]
    assert GraphSession(session.spark, session.graph, max_hops=1).run("MATCH (a:P {id: 1})-[:KNOWS*]->(b) RETURN count(*) AS n").rows == [(2,)]


def test_delete_of_a_relationship_leaves_its_opposite_and_its_parallels(session):
    run = lambda q: session.run(q).rows
    session.execute("MATCH (a:P {id: 2}), (b:P {id: 1}) CREATE (a)-[:KNOWS]->(b)")
    session.execute("MATCH (a:P {id: 1})-[r:KNOWS]->(b:P {id: 2}) DELETE r")
    assert run("MATCH (a:P)-[:KNOWS]->(b:P) RETURN a.id, b.id ORDER BY a.id, b.id") == [(1, 1), (2, 1), (2, 3), (3, 1)]
    session.execute("MATCH (a:P {id: 3}), (b:P {id: 2}) CREATE (a)-[:LIVES {since: 1}]->(:C {id: 50}), (a)-[:KNOWS]->(b), (a)-[:KNOWS]->(b)")
    assert run("MATCH (:P {id: 3})-[r:KNOWS]->(:P {id: 2}) RETURN count(*) AS n") == [(2,)]
    session.execute("MATCH (:P {id: 3})-[r:KNOWS]->(:P {id: 2}) WITH r LIMIT 1 DELETE r")
    assert run("MATCH (:P {id: 3})-[r:KNOWS]->(:P {id: 2}) RETURN count(*) AS n") == [(1,)]
    assert session.run("MATCH (p:P {id: 3}) DELETE p").error_kind == "runtime"
    assert run("MATCH (p:P) RETURN count(*) AS n") == [(3,)]


def test_set_and_remove_on_a_relationship(session):
    run = lambda q: session.run(q).rows
    assert run("MATCH (p:P {id: 1})-[r:LIVES]->(c) SET r.since = 99 RETURN r.since") == [(99,)]
    assert run("MATCH (p:P)-[r:LIVES]->(c) RETURN p.id, r.since ORDER BY p.id") == [(1, 99), (2, 2005)]
    session.execute("MATCH (p:P {id: 2})-[r:LIVES]->(c) REMOVE r.since")
    assert run("MATCH (p:P)-[r:LIVES]->(c) RETURN p.id, r.since ORDER BY p.id") == [(1, 99), (2, None)]


def test_merge(session):
    run = lambda q: session.run(q).rows
    edges = "MATCH (a:P)-[r:LIVES]->(c:C) RETURN a.id, c.id, r.since ORDER BY a.id, c.id"
    session.execute("MERGE (a:P {id: 3})-[:LIVES]->(b:C {id: 1})")
    session.execute("MERGE (a:P {id: 3})-[:LIVES]->(b:C {id: 1})")
    assert run(edges) == [(1, 1, 2001), (2, 1, 2005), (3, 1, None)]
    assert run("MERGE (c:C {name: 'x'}) RETURN c.id, c.name") == [(1, "x")]
    session.execute("MATCH (p:P) MERGE (c:C {name: p.name})")
    assert run("MATCH (c:C) RETURN c.name ORDER BY c.name") == [("ann",), ("bob",), ("cy",), ("x",), ("y",)]
    session.execute("MATCH (p:P) MATCH (c:C {name: p.name}) MERGE (p)-[r:LIVES]->(c) ON CREATE SET r.since = 7 ON MATCH SET r.since = 8")
    session.execute("MATCH (p:P {id: 1}) MATCH (c:C) WHERE c.name = 'ann' OR c.name = 'y' MERGE (p)-[r:LIVES]->(c) ON CREATE SET r.since = 9 ON MATCH SET r.since = 8, p.age = 31")
    assert sorted(run("MATCH (p:P)-[r:LIVES]->(c:C) WHERE r.since < 10 RETURN p.name, c.name, r.since")) == [("ann", "ann", 8), ("ann", "y", 9), ("bob", "bob", 7), ("cy", "cy", 7)]
    assert run("MATCH (p:P {id: 1}) RETURN p.age") == [(31,)]
    session.execute("UNWIND [5, 5, 6] AS x MERGE (p:P {id: x}) ON CREATE SET p.name = 'new'")
    assert run("MATCH (p:P {name: 'new'}) RETURN p.id ORDER BY p.id") == [(5,), (6,)]
    assert run("MATCH (a:P {id: 1}), (b:P {id: 2}) MERGE (b)-[:KNOWS]-(a) RETURN count(*) AS n") == [(1,)]
    assert run("MATCH (:P)-[:KNOWS]->(:P) RETURN count(*) AS n") == [(4,)]
    ids = [r[0] for r in run("MATCH (c:C) RETURN c.id")]
    assert len(ids) == len(set(ids))


def test_a_made_relationship_is_bound(session):
    assert session.run("MATCH (a:P {id: 2}), (b:P {id: 1}) CREATE (a)-[r:LIVES {since: 3}]->(c:C {id: 9, name: a.name}) RETURN type(r) AS t, r.since, c.name").rows == [("LIVES", 3, "bob")]
    assert session.run("CREATE (a:P)-[:KNOWS]->(b:P) RETURN a.id <> b.id AS x").rows == [(True,)]
    assert session.run("MATCH (a:P {name: 'ann'}) SET a = 3").error_kind == "runtime"
