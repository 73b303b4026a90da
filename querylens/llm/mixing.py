"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets share a budget by weight; a source stops at `max_epochs` times its own size and what it can't take is
reshared among the others by weight until none is above its cap. The fixed point has a closed form: order the
sources by cap / weight; the capped ones are a prefix of that order, and the level of the others is (budget -
their caps) / (their weights). That is one window over the per-source table, not a loop.

Sampling: a source with target / size = r takes every document floor(r) times; the rest of r is filled with
documents in the order of a seeded digest of their id, up to the point nearest to the target. The order's running
sum is taken inside (source, digest bucket) and continued over buckets by a prefix sum, so a source that holds a
third of all rows is spread over BUCKETS windows.

Defined results: null text has size 0, null source is a source of its own and last, repeated rows are each taken
on their own, a row without words is never taken, an empty table gives an empty result. `take` shuffles no texts; `mix` joins
the counts of copies to the rows, which shuffles them. Extra columns are kept, whatever their names, but for those that
are named like a result (source_size, target, copies), which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm._shared import WORD, checkpointed, table

BUCKETS = 1024
MAX_EPOCHS = 3
SEED = "mix-1"
BROADCAST_SOURCES = 100_000  # rows; a larger source table is joined by key instead


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float, budget: float | None = None) -> DataFrame:
    """Add `target` to a table of sources with `weight` > 0 and `source_size`."""
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("caps_before")) / (F.sum("weight").over(everything) - F.col("weights_before"))
    out = (
        sources.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.lit(budget) if budget is not None else F.sum("source_size").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", level)
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    # the first free source's level holds for all after it; sources before it stand at their cap
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "source_key", "level"))).over(everything)["level"]
    target = F.when(F.col("free"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return out.withColumn("target", target).drop("cap", "total", "caps_before", "weights_before", "level", "free")


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last."""
    return sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)


def take(sized: DataFrame, weigh=cyclic_weights, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Add source_size, target and copies (how often the mix takes the row) to rows with doc_id, source and size.

    `weigh` adds a `weight` column to the table (source, source_key, source_size). `sized` is read several times, so give it
    checkpointed.
    """
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    extra = [c for c in sized.columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies")]
    # extra columns lie in one struct meanwhile, so that their names meet no other
    rows = sized.select("doc_id", "source", "size", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(extra)]).alias("extra"))
    rows = rows.withColumns(
        {"source_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "draw": F.substring(digest, 1, 16), "bucket": F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % BUCKETS}
    )
    parts = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("part_size"), F.first("source").alias("source"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = checkpointed(parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0))))
    sources = parts.groupBy("source_key").agg(F.sum("part_size").alias("source_size"), F.first("source").alias("source"))
    sources = checkpointed(water_fill(weigh(sources), max_epochs))
    small = sources.select("source_key", "source_size", "target")
    if small.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = parts.drop("source").join(small, "source_key").withColumn("whole", F.floor(rate)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("part_start") + F.sum("size").over(inside) - F.col("size") / 2
    return (
        rows.join(parts.drop("part_size"), ["source_key", "bucket"])
        .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.when(middle <= F.col("rest"), 1).otherwise(0)).otherwise(0))
        .select("doc_id", "source", "size", *[F.col(f"extra.x{k}").alias(c) for k, c in enumerate(extra)], "source_size", "target", "copies")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows themselves: each document as often as the mix takes it, with its own columns."""
    copies = take(checkpointed(docs.select("doc_id", "source", n_words("text").alias("size"))), **how)
    # equal (doc_id, source, size) rows may differ in their text: deal their copies out in the order of a digest of it
    chosen = copies.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("c"))
    chosen = chosen.toDF("c0", "c1", "c2", "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(docs.columns)]).alias("row"), F.col("doc_id").alias("d0"), F.col("source").alias("d1"), n_words("text").alias("d2"), F.xxhash64("text").alias("d3"))
    if chosen.filter(F.size("copies") > 1).isEmpty():
        pick = F.get("copies", F.lit(0))
    else:
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("d0", "d1", "d2").orderBy("d3")))
        pick = F.get("copies", F.col("k") - 1)
    out = rows.join(chosen, F.col("d0").eqNullSafe(F.col("c0")) & F.col("d1").eqNullSafe(F.col("c1")) & (F.col("d2") == F.col("c2")))
    out = out.filter(pick > 0).select("row", F.explode(F.array_repeat(F.lit(0), pick.cast("int"))))
    return out.select(*[F.col(f"row.x{k}").alias(c) for k, c in enumerate(docs.columns)])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = checkpointed(docs.select("doc_id", "source", n_words("text").alias("size")))
    return take(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source_key, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY min(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source_key
), filled AS (
  SELECT *, source_size * {MAX_EPOCHS} AS cap,
    (sum(source_size) OVER () - coalesce(sum(source_size * {MAX_EPOCHS}) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM sources WINDOW b AS (ORDER BY (source_size * {MAX_EPOCHS})::DOUBLE / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source_key, source_size, CASE WHEN level * weight <= cap
    THEN first_value(level) OVER (ORDER BY level * weight > cap, cap::DOUBLE / weight, source_key) * weight ELSE cap::DOUBLE END AS target
  FROM filled
), placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY source_key ORDER BY (('0x' || substring(digest, 1, 4))::BIGINT % {BUCKETS}), substring(digest, 1, 16), size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle
  FROM sized JOIN targets USING (source_key)
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""
