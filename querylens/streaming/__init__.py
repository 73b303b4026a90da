"""Extension: scorers and the roll-up over a stream of completions. Batch and stream use the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions import text as X
from querylens.operators import evaluate as ev


def score_stream(rows: DataFrame) -> DataFrame:
    """Add pred, em, bleu and r_length to a streaming (or batch) DataFrame with completion, cypher and n_tokens. No state is kept."""
    rows = rows.withColumn("pred", X.extract_query(F.col("completion")))
    return rows.withColumns({"em": X.exact_match(F.col("pred"), F.col("cypher")), "bleu": X.bleu4(F.col("cypher"), F.col("pred")), "r_length": X.length_penalty(F.col("n_tokens"))})


def write_scores(rows: DataFrame, path: str, checkpoint: str):
    """Start a query that appends scores as Parquet and takes up at its checkpoint after a failure."""
    return score_stream(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SUMS = [*ev.METRICS, "n"]


def source_sums(rows: DataFrame, backend: str = "typed") -> DataFrame:
    """Running sums of the row metrics for each source: the state of a streaming roll-up, one row a source."""
    scored = ev.row_metrics(rows, backend=backend)
    return scored.groupBy("data_source").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in ev.METRICS], F.count(F.lit(1)).alias("n"))


def write_rollup(rows: DataFrame, path: str, checkpoint: str, backend: str = "typed"):
    """Start a query that keeps the roll-up's sums under `path` and takes up at its checkpoint after a failure.

    Sums are state of the stream. Each micro-batch gives the new sums of the sources it touched and writes them to a folder
    named by its number, replacing it. A batch that is run again after a failure writes the same sums to the same folder, so
    every row counts once, wherever the failure was.
    """

    def merge(updated: DataFrame, number: int) -> None:
        updated.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    sums = source_sums(rows, backend)
    return sums.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The roll-up from the last sums of each source: a total row (is_total 1) and one for each source."""
    parts = spark.read.schema("data_source string, " + ", ".join(f"{c} double" for c in ev.METRICS) + ", n long, batch long").parquet(f"{path}/batch-*")
    last = parts.groupBy("data_source").agg(F.max_by(F.struct(*SUMS), "batch").alias("s")).select("data_source", *[F.col(f"s.{c}").alias(c) for c in SUMS])
    means = [(F.sum(c) / F.sum("n")).alias(c) for c in ev.METRICS]
    return last.rollup("data_source").agg(F.grouping("data_source").cast("int").alias("is_total"), *means, F.sum("n").alias("n")).select("is_total", "data_source", *SUMS)
