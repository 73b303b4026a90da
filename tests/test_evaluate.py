import json

import pytest
from pyspark.sql import functions as F

from querylens.operators import evaluate as ev
from querylens.operators import schema as sc
from querylens.operators import schema_native as sn
from querylens.sources.adapters import strided_sample

S = "(:A)-[:R]->(:B)"
ROWS = [(0, "a", "RETURN 1", "RETURN 1"), (1, "a", "RETURN 1", "bad ("), (2, None, "MATCH (a:A) RETURN a", "MATCH (b:B) RETURN b"), (3, "b", "RETURN 2", None)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, s, f"q{i}", S, g, c) for i, s, g, c in ROWS], "row_id long, data_source string, question string, schema string, cypher string, completion string")


def test_report(rows, tmp_path, spark):
    report = ev.evaluate(rows, output_path=f"{tmp_path}/report")
    assert report["overall"]["n"] == 4 and report["overall"]["execution_accuracy"] == 0.5 and report["overall"]["em"] == 0.25
    assert set(report["per_source"]) == {"a", None, "b"} and report["per_source"][None]["execution_accuracy"] == 1.0
    assert [e["question"] for e in report["examples_logged"]] == ["q0", "q1", "q2", "q3"]
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/report", wholetext=True).collect())
    assert json.loads(text)["overall"]["n"] == 4
    assert ev.evaluate(rows, max_examples=2)["overall"]["n"] == 2
    assert set(ev.evaluate(rows.drop("data_source"))["per_source"]) == {"unknown"}
    empty = ev.evaluate(rows.limit(0))
    assert empty["overall"] == {"bleu": 0.0, "em": 0.0, "execution_accuracy": 0.0, "n": 0} and not empty["per_source"]


def test_running_mean(spark):
    d = spark.range(130).selectExpr("id AS row_id", "CAST(id % 2 AS DOUBLE) AS v")
    assert {r.row_id: r.running for r in ev.running_mean(d, "v", "row_id").collect()} == {49: 0.5, 99: 0.5}


def test_group_advantage(spark):
    d = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 0.5), (2, 0.5)], "prompt_id long, reward double")
    got = sorted((r.prompt_id, round(r.advantage, 6)) for r in ev.group_advantage(d).collect())
    assert got == [(1, -0.707107), (1, 0.707107), (2, 0.0), (2, 0.0)]


def test_parse_rate(spark):
    d = sn.compile_column(spark.createDataFrame([(S,), (None,), ("",), ("hello",), (S,)], "schema string"))
    r = sc.parse_rate(d).first()
    assert (r.total, r.trivial, r.non_trivial_rate) == (5, 3, 0.4)
    assert sc.parse_rate(d.limit(0)).first().non_trivial_rate == 0.0


def test_completions_from_a_hook(rows):
    bare = rows.drop("completion")
    asked = ev.evaluate(bare, generate=lambda prompt: F.when(prompt.contains("q0"), "RETURN 1").otherwise(F.lit(None)))
    assert [e["pred"] for e in asked["examples_logged"]] == ["RETURN 1", "", "", ""]

    def model(prompt):
        if "q1" in prompt:
            raise ValueError("out of memory")
        return "RETURN 1" if prompt == "Ask: q0 of (:A)-[:R]->(:B)" else "none"

    asked = ev.evaluate(bare, prompt_template="Ask: {question} of {schema}", generate=ev.generator(model))
    assert [e["pred"] for e in asked["examples_logged"]] == ["RETURN 1", "", "none", "none"]


def test_strided_sample_over_many_partitions(spark):
    adaptive = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k, None) for k in adaptive}
    try:
        for k, v in adaptive.items():
            spark.conf.set(k, v)
        d = spark.range(0, 300_000, 3, 16).select((F.col("id") * 7 % 300_007).alias("k"), F.lit("x").alias("v"))
        keys = sorted(r.k for r in d.collect())
        got = strided_sample(d, "k", 200)
        assert sorted(r.k for r in got.collect()) == keys[:: len(keys) // 200] and got.columns == ["k", "v"]
        assert strided_sample(d.limit(150), "k").count() == 150 and strided_sample(d.limit(0), "k").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_running_mean_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(ev, "BLOCKS", 3)
    d = spark.range(1000).selectExpr("id AS row_id", "CAST(id AS DOUBLE) AS v")
    assert {r.row_id: r.running for r in ev.running_mean(d, "v", "row_id", 10).collect()} == {k: k / 2 for k in range(9, 1000, 10)}


def test_public_names():
    import querylens

    assert all(hasattr(querylens, n) for n in querylens.__all__)


def test_batches_are_split_at_the_prompt_that_fails():
    calls = []

    def model(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise RuntimeError
        return [None if p == "none" else p.upper() for p in prompts] if "short" not in prompts else ["x"] * (len(prompts) + 1)

    prompts = ["a", "bad", "b", "a", "none", "short", "", "c"]
    assert ev.answers(model, prompts, 4) == ["A", "", "B", "A", "", "", "", "C"]
    assert max(calls) <= 4 and ev.answers(model, [], 4) == []


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def load():
        with open(loads, "a") as f:
            f.write("x")
        return lambda prompts: [f"MATCH {len(prompts)} {p[-5:]}" for p in prompts]

    df = spark.createDataFrame([(k, f"q{k:05}", "s", "MATCH") for k in range(50)], "row_id long, question string, schema string, cypher string").repartition(8)
    hook = ev.batch_generator(load, 10)
    got = ev.with_completions(df, prompt_template="{schema} {question}", generate=hook)
    assert all(r.completion.endswith(f"{r.row_id:05}") for r in got.collect())
    got.count()
    with open(loads) as f:
        assert 1 <= len(f.read()) <= 8
