"""Batch evaluation: row metrics, then overall and per-source means, samples and a JSON report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions import text as X
from querylens.operators.judge import judge_column

METRICS = ("bleu", "em", "exec")
BLOCKS = 4096  # of a chunk of the running mean


def row_metrics(df: DataFrame, completion: str = "completion", backend: str = "typed") -> DataFrame:
    """Add pred, bleu, em and exec. Execution extracts from the extracted query once more, as scoring a prediction does."""
    if "data_source" not in df.columns:
        df = df.withColumn("data_source", F.lit("unknown"))
    df = df.withColumn("pred", X.extract_query(F.col(completion)))
    df = df.withColumns({"bleu": X.bleu4(F.col("cypher"), F.col("pred")), "em": X.exact_match(F.col("pred"), F.col("cypher")), "__again": X.extract_query(F.col("pred"))})
    return judge_column(df, "__again", out="__grade", backend=backend).withColumn("exec", (F.col("__grade") >= 1.0).cast("int")).drop("__again", "__grade")


def rollup(rows: DataFrame, source: str = "data_source") -> DataFrame:
    """One total row (is_total 1) and one row per source, a null source among them; no rows give no row.

    Row metrics are summed per source first, so the rollup's copies are of that small table and not of the rows.
    """
    sums = rows.groupBy(source).agg(*[F.sum(c).alias(c) for c in METRICS], F.count(F.lit(1)).alias("n"))
    means = [(F.sum(c) / F.sum("n")).alias(c) for c in METRICS]
    return sums.rollup(source).agg(F.grouping(source).cast("int").alias("is_total"), *means, F.sum("n").alias("n")).select("is_total", source, *METRICS, "n")


def running_mean(rows: DataFrame, value: str, order: str, every: int = 50) -> DataFrame:
    """Mean of all rows up to each `every`-th one, by a 0-based gapless order column.

    Sums of blocks of `every` rows come first, then sums of chunks of BLOCKS blocks: only the chunks, a row for each
    every * BLOCKS rows, are in one ordered window; the blocks are summed up chunk by chunk.
    """
    blocks = rows.groupBy(F.floor(F.col(order) / every).alias("block")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("k"))
    blocks = blocks.withColumn("chunk", F.floor(F.col("block") / BLOCKS))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = blocks.groupBy("chunk").agg(F.sum("s").alias("cs"), F.sum("k").alias("ck"))
    chunks = chunks.select("chunk", F.coalesce(F.sum("cs").over(before), F.lit(0)).alias("cs"), F.coalesce(F.sum("ck").over(before), F.lit(0)).alias("ck"))
    upto = Window.partitionBy("chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = blocks.select("chunk", "block", "k", F.sum("s").over(upto).alias("s"), F.sum("k").over(upto).alias("n")).join(chunks, "chunk")
    means = sums.select("block", "k", ((F.col("cs") + F.col("s")) / (F.col("ck") + F.col("n"))).alias("running"))
    return means.filter(F.col("k") == every).select(((F.col("block") + 1) * every - 1).alias(order), "running")


def first_rows(df: DataFrame, n: int | None, order: str) -> DataFrame:
    return df if n is None else df.orderBy(order).limit(n)


def generator(complete: Callable[[str], str]) -> Callable[[Column], Column]:
    """A hook for `evaluate` from a function of one prompt, run in Arrow batches; where it fails the completion is empty."""

    def one(prompt: str) -> str:
        try:
            return complete(prompt) or ""
        except Exception:
            return ""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(one)

    return run


Model = Callable[[list[str]], list[str]]
_models: dict[str, Model] = {}  # of a Python worker
PROMPTS_AT_ONCE = 64


def answers(model: Model, prompts: list[str], at_once: int = PROMPTS_AT_ONCE) -> list[str]:
    """A model's answers to prompts, `at_once` of them a call; equal prompts are asked once.

    A call that fails, or gives another number of answers, is split in halves, down to the prompt at fault, whose answer is
    empty. So one bad prompt costs its batch some calls and no other row its answer.
    """

    def ask(some: list[str]) -> list[str]:
        try:
            found = list(model(some))
            if len(found) == len(some):
                return ["" if x is None else str(x) for x in found]
        except Exception:
            pass
        if len(some) == 1:
            return [""]
        half = len(some) // 2
        return ask(some[:half]) + ask(some[half:])

    different = list(dict.fromkeys(prompts))
    known: dict[str, str] = {}
    for k in range(0, len(different), at_once):
        part = different[k : k + at_once]
        known.update(zip(part, ask(part), strict=True))
    return [known[p] for p in prompts]


def batch_generator(load: Callable[[], Model], at_once: int = PROMPTS_AT_ONCE) -> Callable[[Column], Column]:
    """A hook for `evaluate` from a model that answers several prompts a call.

    `load` makes the model, once in each Python worker that meets the hook, however many tasks and batches it runs; prompts
    come in Arrow batches and are asked `at_once` at a time. Null prompts are empty ones.
    """
    token = uuid.uuid4().hex

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if token not in _models:
            _models[token] = load()
        for prompts in parts:
            yield pd.Series(answers(_models[token], prompts.fillna("").tolist(), at_once), dtype=object)

    return run


def with_completions(df: DataFrame, completion: str = "completion", prompt_template: str | None = None, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """The completion of each row: `generate` of its prompt if given, else the column of that name; null becomes empty."""
    made = F.col(completion) if generate is None else generate(X.prompt(F.col("schema"), F.col("question"), prompt_template or X.PROMPT))
    return df.withColumn(completion, F.coalesce(made, F.lit("")))


def evaluate(
    df: DataFrame, order: str = "row_id", completion: str = "completion", max_examples: int | None = None, backend: str = "typed", output_path: str | None = None,
    prompt_template: str | None = None, generate: Callable[[Column], Column] | None = None,
) -> dict:
    """The report as a dict: overall, per_source and the first five rows. Writes it as one JSON file if a path is given.

    Completions are read from a column, or made by `generate`, a function from the prompt's column to the completion's
    (see `generator` and `batch_generator`); `prompt_template` has the places {schema} and {question}. What comes to the driver is one row per
    source and five samples.
    """
    rows = row_metrics(with_completions(first_rows(df, max_examples, order), completion, prompt_template, generate), completion, backend)
    report: dict = {"overall": dict.fromkeys(("bleu", "em", "execution_accuracy"), 0.0) | {"n": 0}, "per_source": {}, "examples_logged": []}
    for r in rollup(rows).collect():
        entry = {"bleu": r["bleu"], "em": r["em"], "execution_accuracy": r["exec"], "n": r["n"]}
        if r["is_total"]:
            report["overall"] = entry
        else:
            report["per_source"][r["data_source"]] = entry
    for r in first_rows(rows, 5, order).collect():
        report["examples_logged"].append({"question": r["question"], "gold": r["cypher"], "pred": r["pred"], "bleu": r["bleu"], "em": r["em"], "exec": r["exec"]})
    if output_path:
        write_report(df.sparkSession, report, output_path)
    return report


def write_report(spark, report: dict, path: str) -> None:
    """One JSON text file in a folder, replaced as a whole."""
    text = json.dumps(report, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def group_advantage(rows: DataFrame, reward: str = "reward", prompt: str = "prompt_id") -> DataFrame:
    """Extension: reward of each rollout relative to its prompt's mean, in standard deviations (0 where all are equal)."""
    w = Window.partitionBy(prompt)
    spread = F.stddev_samp(reward).over(w)
    return rows.withColumn("advantage", F.when(F.coalesce(spread, F.lit(0.0)) > 0, (F.col(reward) - F.avg(reward).over(w)) / spread).otherwise(0.0))
