"""A training-data pipeline over `documents`: quality rules, near-duplicates, repeated passages, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it written as Parquet. All but the last
return the columns of `documents`. Nulls, empty and repeated rows have the results that the operators' docstrings define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from querylens.llm import mixing, packing, quality, simhash, suffix_dedup
from querylens.llm._shared import checkpoint_folder, checkpointed, delete_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# near duplicates: five-word shingles, fingerprints in trees, similarity 0.8 or more
SHINGLE, RADIUS, HASHES, SIMILARITY = 5, 8, 6, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id.

    Links come from vantage-point trees of the fingerprints, and an exact check of the sets follows.
    """
    return simhash.keep_one(docs.select(COLUMNS), SHINGLE, RADIUS, HASHES, SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes that a document with a smaller id has already."""
    return suffix_dedup.remove_repeats(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once, or up to three times."""
    return mixing.mix(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in sequences of 1024."""
    return packing.pack(checkpointed(packing.pieces(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The isolation forest, the fingerprints' components and the suffix arrays can't be put in SQL; a test holds run()
#: against a version of brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared checkpoint folder and read again.

    A stage's result is deleted once the next one is written. The last one written stays, since the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete_folder(spark, f"{folder}/{k - 1}")
    return docs
