"""Queries that nobody should run: each gets a defined grade in bounded time and memory."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querylens.operators import judge
from querylens.plans import empty_graph

SCHEMA = "(:A)-[:R]->(:B)"
HOSTILE = [
    ("UNWIND range(1, 1000000000) AS x RETURN x", "timeout"),
    ("UNWIND range(1, 1000) AS x UNWIND range(1, 1000) AS y UNWIND range(1, 1000) AS z RETURN count(*) AS n", "timeout"),
    ("RETURN [x IN range(1, 1000000000) | x] AS l", "timeout"),
    ("RETURN range(1, 1000000000) AS l", "timeout"),
    ("RETURN range(1, 1000000000) + [1] AS l", "timeout"),
    ("WITH 'aaaaaaaaaaaaaaaa' AS s " + "WITH s + s AS s " * 40 + "RETURN s", "timeout"),
    ("WITH 10 AS x " + "WITH x * x AS x " * 40 + "RETURN x", "runtime"),
    ("RETURN replace('" + "a" * 3000 + "', 'a', '" + "b" * 30000 + "') AS s", "timeout"),
    ("RETURN '" + "a" * 60 + "' =~ '(a|aa)+(?:b|c)' AS s", "timeout"),
    ("RETURN round(1.5, 1000000000) AS r", None),
    ("RETURN " + "(" * 3000 + "1" + ")" * 3000 + " AS x", "runtime"),
    ("RETURN " + "({a:" * 24 + "1 AS x", "parse"),
    ("RETURN " + "({a:" * 90 + "1 AS x", "runtime"),
    ("RETURN " + "9" * 6000 + " AS x", "parse"),
    ("RETURN 9223372036854775807 + 1 AS x", "runtime"),
    ("RETURN [1, 2]['a'..2] AS x", "runtime"),
    ("RETURN 1 AS x SKIP 'a' LIMIT 2", "runtime"),
    ("RETURN '\\ud800' AS x", None),
    ("RETURN 'a' =~ '(' AS x", "runtime"),
    ("UNWIND range(1, 100000) AS x RETURN x", None),
    ("RETURN size(range(1, 1000000000)) AS n, 5 IN range(1, 1000000000) AS i", None),
]


@pytest.mark.parametrize(("query", "kind"), HOSTILE)
def test_hostile(query, kind):
    began = time.time()
    ran, rows, _, found = judge.execute(SCHEMA, query)
    assert (ran, found) == (kind is None, kind) and time.time() - began < 5
    want = judge.RAN if kind is None else judge.grade(ran, kind)
    assert judge.judge_one(query, "MATCH (a:A) RETURN a", SCHEMA) == want
    assert rows is None or len(rows) <= empty_graph.ROW_CAP


PIECES = "RETURN WITH UNWIND MATCH ( ) [ ] { } a b :A -[:R]-> AS , . .. 1 2.5 'x' + - * / % ^ = < IN STARTS NOT AND range( size( left( round( date( split( collect( count(*) CASE WHEN THEN END NULL | ORDER BY LIMIT SKIP MERGE CREATE SET ON DELETE DISTINCT WHERE FOREACH".split(" ")


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_any_text_has_a_grade(pieces):
    assert judge.judge_one(" ".join(["RETURN", *pieces]), "RETURN 1", SCHEMA) in (0.0, 0.3, 0.7, 1.0)
    assert judge.judge_one(" ".join(pieces), "RETURN 1", SCHEMA) in (0.0, 0.3, 0.7, 1.0)
