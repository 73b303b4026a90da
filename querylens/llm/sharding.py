"""Weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has one pseudo-random number u in (0, 1); the record goes to the shard with the
least -ln(u) / weight. A shard's share is its weight's share, and a shard that is added takes records only
into itself: no other pair's number changes. All of it is column expressions; only the slot numbers shuffle,
and they shuffle ids and sizes, never texts.

Defined results: a null key hashes like the empty string, a null text has size 16 and crc32 0, repeated rows
go to the same shard and get slots of their own, an empty table gives an empty result. Extra columns stay
out of the result of `op5_sharding`; `assign_shards` keeps all columns, but for one that is named like its result (`out`),
which the result replaces; `write_shards` refuses to lose a column that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import checkpointed, gapless_rank, table

N_SHARDS = 40
BUCKETS = 256  # parts of a shard that number their slots on their own
EXTRA_BYTES = 16


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Struct (v, s): the winning draw and shard for a string key."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: draw(key, s, F.get(w, s))))


def draw(key: Column, s: Column, weight: Column) -> Column:
    """Struct (v, s) of a key and one shard."""
    # 52 bits of the digest, so the draw is the same double on every engine
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), s.cast("string"))), 1, 13), 16, 10).cast("double")
    return F.struct((-F.ln((u + 0.5) / float(2**52)) / weight).alias("v"), s.alias("s"))


def assign_shards(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """Add the shard number of each row; shards are numbered 0 to len(weights) - 1."""
    return df.withColumn(out, rendezvous(F.coalesce(F.col(key).cast("string"), F.lit("")), weights)["s"])


def write_shards(df: DataFrame, key: str, weights: list[float], path: str, out: str = "shard") -> None:
    """Write one folder per shard, named by `out`. A shard's rows stay spread over the tasks that hold them."""
    if out in df.columns:
        raise ValueError(f"the rows have a column {out}: name another one for the shards")
    assign_shards(df, key, weights, out).write.partitionBy(out).parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + EXTRA_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int").alias("bucket"),
        F.array(rendezvous(key, [1.0] * N_SHARDS), draw(key, F.lit(N_SHARDS), F.lit(1.0))).alias("draws"),  # a new shard changes no other draw
    )
    slim = checkpointed(slim.select("doc_id", "size", "text_crc32", "bucket", F.get("draws", F.lit(0))["s"].alias("shard"), F.array_min("draws")["s"].alias("grown_shard")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    return gapless_rank(slim, "shard", "bucket", order, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


# CRC-32 in SQL, reversed polynomial 0xEDB88320. The table is linear over xor, so the entry of a byte is the xor of the entries of its bits.
_BITS = [0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320]  # fixed values
_ENTRY = "0::BIGINT"
for _k, _v in enumerate(_BITS):
    _ENTRY = f"xor({_ENTRY}, ((xor(a, b) >> {_k}) & 1) * {_v})"

_CRC32 = f"""
WITH hexed AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
crcs AS (
  SELECT doc_id, text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(h, lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, {_ENTRY})), 4294967295::BIGINT) AS text_crc32
  FROM hexed
)
"""

OP5_SQL = (
    _CRC32
    + f"""
, pairs AS (
  SELECT k.key, s::INT AS s, -ln((('0x' || substring(md5(k.key || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / 1.0::DOUBLE AS v
  FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS key FROM documents) k, range({N_SHARDS + 1}) r(s)
), placed AS (
  SELECT key, arg_min(s, v) FILTER (s < {N_SHARDS}) AS shard, arg_min(s, v) AS grown_shard FROM pairs GROUP BY key
)
SELECT doc_id, strlen(text)::BIGINT + {EXTRA_BYTES} AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substring(md5(key), 1, 2), doc_id, strlen(text), text_crc32) - 1 AS slot, grown_shard
FROM crcs JOIN placed ON key = coalesce(doc_id::VARCHAR, '')
"""
)
