import json
import random

import pytest
from pyspark.sql import functions as F

from querylens.operators import schema as sc
from querylens.operators import schema_native as sn
from querylens.sources.adapters import SCHEMAS

NAMES = ["A", "b_1", "Über x", "A", "R", "S", "t y", " pad ", "-", "Zed"]
KINDS = ["STRING", "integer", "Float", "LIST", "DATE_TIME", "POINT", "bool", ""]


def made(rng):
    props = lambda: {rng.choice(["p", "q", "name", "Q"]): rng.choice([{"type": rng.choice(KINDS)}, {"indexed": True}, {"type": None}, "text", 3, ["l"], {}]) for _ in range(rng.randint(0, 4))}

    def entry():
        if rng.random() < 0.4:
            ends = {rng.choice(["from", "start", "to", "end"]): rng.choice([[rng.choice(NAMES)], [], "A", [rng.choice(NAMES), "B"], None]) for _ in range(rng.randint(0, 4))}
            return {"type": "relationship", **ends, "properties": props()}
        return rng.choice([{"type": "node", "properties": props()}, {"properties": props()}, {"type": "node", "properties": ["a", "b"]}, {"type": "node"}, {"type": "Node", "properties": None}, "no", 5, None, [1]])

    def as_json():
        text = json.dumps({rng.choice(NAMES): entry() for _ in range(rng.randint(0, 6))}, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        return rng.choice([text, text, text, text[:-1], " " + text + "\n", text.replace(":", " : ")])

    def markdown():
        lines = [rng.choice(["Node properties:", "- **A**", "- **b_1** x", "**R** and **S**", "  - `p`: STRING", "  - `q` - INTEGER Example", "`p`:FLOAT", "`bad name`: STRING", "Relationship properties:", "The RELATIONSHIPS:", "(:A)-[:R]->(:S)", "( A ) - [ R ] - ( b_1 )", "()-[:R]->()", "(:A)-[:R]->(:S)"]) for _ in range(rng.randint(0, 10))]
        return rng.choice(["\n", "\r\n", " "]).join(lines)

    def blocks():
        lines = [rng.choice(["A {p: STRING, q: INTEGER}", "  R {w: FLOAT, w: DATE}", "S {}", "Zed {1}", "A {q: FLOAT}", "{'start': A, 'type': R, 'end': S}", '{"start": S, "type": R, "end": S}', "{start:A,type:T,end:Zed}", "A{p:INT}", "B {p: STRING} tail", "T { x : bool }", "{'start': A, 'type': R, 'end': S}"]) for _ in range(rng.randint(0, 9))]
        return rng.choice(["\n", "\n\n", "\r\n"]).join(lines)

    return rng.choice([as_json, markdown, blocks, lambda: markdown() + "\n" + blocks()])()


def test_native_equals_the_reader(spark):
    rng = random.Random(11)
    texts = [*SCHEMAS, None, "", " ", "{}", "{", "[]", "null", '{"A": {"type": "node"}, "A": {"properties": {"p": {"type": "INT"}}}}', '{"a b": {"type": "node", "properties": {"x": {"type": "INT"}}}, "a_b": {"type": "node", "properties": {"y": {}}}}', *[made(rng) for _ in range(1250)]]
    df = spark.createDataFrame([(k, t, "e", "e") for k, t in enumerate(texts)], "k long, schema string, text string, props string")
    got = {r.k: r.ddl for r in sn.compile_column(df).collect()}
    assert len(got) == len(texts)
    wrong = [(t, got[k], sc.compile_schema(t)) for k, t in enumerate(texts) if got[k] != sc.compile_schema(t)]
    assert not wrong, (len(wrong), wrong[:2])
    assert len(set(got.values())) > 300


def test_no_python_worker_and_no_text_in_a_join_of_few(spark):
    df = spark.createDataFrame([(SCHEMAS[0],)] * 5, "schema string")
    plan = sn.compile_column(df)._jdf.queryExecution().toString() + df.select(sn.ddl_of(F.col("schema")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "BroadcastHashJoin" in plan
    assert sn.compile_column(df.limit(0)).count() == 0


def test_many_texts_are_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(sn, "BROADCAST_TEXTS", 2)
    df = spark.createDataFrame([(k, f"L{k % 9} {{p: STRING}}") for k in range(60)], "k long, schema string")
    assert {r.k: r.ddl for r in sn.compile_column(df).collect()} == {k: sc.compile_schema(f"L{k % 9} {{p: STRING}}") for k in range(60)}


@pytest.mark.parametrize("text", SCHEMAS)
def test_the_adapters_schemas(spark, text):
    assert spark.range(1).select(sn.ddl_of(F.lit(text)).alias("d")).first().d == sc.compile_schema(text)
