"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (each the longest phrase seen before plus one byte). The set of
phrases stands for what a compressor learns from the text. Phrases are hashed to 64 bits; one-permutation minimum hashing
keeps the least hash in each of SLOTS slots, empty slots borrow from the next filled one, and one byte of each minimum is
written. The share of equal bytes, corrected for chance, estimates the Jaccard likeness of the phrase sets.

`op7_lz_fingerprint` also fingerprints each text with its last half replaced by the next document's start. For the order
of documents the ids' quantiles, MOST_PARTS at most, deal them out by descending id; a document whose id is a bound goes to the
part before as well, as its last neighbour. A part is sorted by Spark, which spills, and read in order and in small batches. The parse of a text up to its middle is shared
by the text and its edited version.

Defined results: a null text is empty; an empty text's fingerprint is all zeros, its likeness is 1 to itself and 0 to any
other; equal ids follow each other by text; null ids come last; a table's only document is its own next one; an empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import shards_for, table

SLOTS = 128  # a power of two
BYTES_PER_PART = 8 << 20
MOST_PARTS = 1 << 16  # so what tasks need to know of the bounds is at most half a megabyte; beyond 512 GB parts grow instead
BATCH_ROWS = 256
BATCH_CHARS = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Parser:
    """Incremental parse: phrase k > 0 is phrase parents[k - 1] plus the byte symbols[k - 1]; phrase 0 is empty."""

    __slots__ = ("known", "node", "parents", "symbols")

    def __init__(self):
        self.known: dict[int, int] = {}
        self.parents: list[int] = []
        self.symbols = bytearray()
        self.node = 0

    def copy(self) -> Parser:
        out = Parser()
        out.known, out.parents, out.symbols, out.node = self.known.copy(), self.parents.copy(), self.symbols[:], self.node
        return out

    def feed(self, data: bytes) -> Parser:
        known, find, node = self.known, self.known.get, self.node
        add_parent, add_symbol, new = self.parents.append, self.symbols.append, len(self.parents) + 1
        for c in data:
            key = node << 8 | c
            to = find(key)
            if to is None:
                known[key] = new
                new += 1
                add_parent(node)
                add_symbol(c)
                node = 0
            else:
                node = to
        self.node = node
        return self


def phrase_hashes(parsers: list[Parser]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every phrase of every parser, and the parser it belongs to."""
    sizes = np.array([len(p.parents) for p in parsers])
    owner = np.repeat(np.arange(len(parsers)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    parent = np.concatenate([[0], *[np.array(p.parents, np.int64) for p in parsers]]).astype(np.int64)
    parent[1:] += np.where(parent[1:] > 0, first[owner], 0)
    h = np.zeros(len(parent), np.uint64)
    h[1:] = np.frombuffer(b"".join(bytes(p.symbols) for p in parsers), np.uint8).astype(np.uint64) + np.uint64(1)
    power = _MULTIPLIER
    with np.errstate(over="ignore"):
        while parent.any():  # polynomial hash along the parents, twice as far each round
            h += power * h[parent]
            parent = parent[parent]
            power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
        return mixed(h[1:]), owner


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signatures(parsers: list[Parser], slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` bytes for each parser."""
    h, owner = phrase_hashes(parsers)
    least = np.full(len(parsers) * slots, np.iinfo(np.uint64).max)
    np.minimum.at(least, owner * slots + (h & np.uint64(slots - 1)).astype(np.int64), h)
    least = least.reshape(-1, slots)
    empty = least == np.iinfo(np.uint64).max
    with np.errstate(over="ignore"):
        filled = least.copy()
        for k in range(1, slots):
            open_ = empty & (filled == np.iinfo(np.uint64).max)
            if not open_.any():
                break
            lent = np.roll(least, -k, 1)
            filled = np.where(open_ & ~np.roll(empty, -k, 1), mixed(lent + np.uint64(k)), filled)
    out = (mixed(filled) & np.uint64(255)).astype(np.uint8)
    out[empty.all(1)] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two arrays of signatures."""
    same = (a == b).mean(1)
    none = ~a.any(1) | ~b.any(1)
    return np.where(none, (same == 1) * 1.0, np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1))


def fingerprint(text: str | None) -> str:
    return signatures([Parser().feed((text or "").encode())])[0].tobytes().hex()


def _compare(rows: list[tuple[int | None, str]]) -> dict[str, list]:
    """For all rows but the last, which is only the neighbour of the one before."""
    own: list[Parser] = []
    edited: list[Parser] = []
    shas: list[str] = []
    for (_, text), (_, following) in zip(rows, rows[1:], strict=False):
        cut = len(text) - len(text) // 2
        head, replaced = text[:cut], following[: len(text) // 2]
        begun = Parser().feed(head.encode())
        edited.append(begun.copy().feed(replaced.encode()))
        own.append(begun.feed(text[cut:].encode()))
        shas.append(hashlib.sha256((head + replaced).encode()).hexdigest())
    own.append(Parser().feed(rows[-1][1].encode()))
    a, b = signatures(own), signatures(edited)
    return {
        "doc_id": [r[0] for r in rows[:-1]],
        "n_chars": [len(r[1]) for r in rows[:-1]],
        "edited_sha256": shas,
        "fingerprint": [x.tobytes().hex() for x in a[:-1]],
        "edited_fingerprint": [x.tobytes().hex() for x in b],
        "near_edited": likeness(a[:-1], b),
        "near_next": likeness(a[:-1], a[1:]),
    }


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _batches(part: Iterable[tuple[int | None, str]], closed: bool) -> Iterator[pa.RecordBatch]:
    """Results of a part's rows in order. closed: the last row is the neighbour that another part holds."""
    first, rows, size = None, [], 0
    for row in part:
        first = first or row
        rows.append(row)
        size += len(row[1])
        if len(rows) > BATCH_ROWS or len(rows) > 1 and size > BATCH_CHARS:
            yield pa.RecordBatch.from_pydict(_compare(rows), _ARROW)
            rows, size = rows[-1:], len(row[1])
    if not closed and first:
        rows.append(first)
    if len(rows) > 1:
        yield pa.RecordBatch.from_pydict(_compare(rows), _ARROW)


def fingerprint_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of all texts and edited texts; see op7_lz_fingerprint for the columns."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        parts = min(MOST_PARTS, shards_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BYTES_PER_PART, 1))
    asked = [k / parts for k in range(parts)] + [1.0]
    found = docs.agg(F.percentile_approx("doc_id", asked, max(10_000, 4 * parts)).alias("q")).first()["q"] or []
    bounds = np.array(sorted(set(found)), np.int64)  # ids that are there, the largest among them
    if len(bounds):
        bounds = np.unique(np.append(bounds[1:] if len(bounds) > 1 else bounds, docs.agg(F.max("doc_id")).first()[0]))
    n = max(1, len(bounds))

    @F.pandas_udf("part long, bound boolean")
    def part_of(ids: pd.Series) -> pd.DataFrame:
        # parts count from the largest ids down; a part's first id is its bound
        values = ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
        if not len(bounds):
            return pd.DataFrame({"part": np.zeros(len(values), np.int64), "bound": np.zeros(len(values), bool)})
        place = np.searchsorted(bounds, values, "left")
        at = np.minimum(place, len(bounds) - 1)
        return pd.DataFrame({"part": np.minimum(len(bounds) - place, n) - 1, "bound": (bounds[at] == values) & ids.notna().to_numpy()})

    dealt = docs.withColumn("dealt", part_of("doc_id")).select("doc_id", "text", "dealt.part", "dealt.bound")
    if n > 1:
        is_bound = F.col("bound")
        also = F.when(is_bound, F.array(F.struct(F.col("part"), F.lit(False).alias("tail")), F.struct(((F.col("part") + n - 1) % n).alias("part"), F.lit(True).alias("tail"))))
        dealt = dealt.withColumn("to", F.explode(F.coalesce(also, F.array(F.struct(F.col("part"), F.lit(False).alias("tail")))))).select("doc_id", "text", "to.part", "to.tail")
    else:
        dealt = dealt.withColumn("tail", F.lit(False))
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c) for c in ("part", "tail", "doc_id", "text")), strict=True)

        def until_tail(part):
            for _, tail, doc_id, text in part:
                yield doc_id.as_py(), text.as_py()
                if tail.as_py():
                    break  # more rows of the bound's id are not the neighbour

        for _, part in groupby(rows(), lambda r: r[0].as_py()):
            yield from _batches(until_tail(part), n > 1)

    return ordered.mapInArrow(run, _RESULT)


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
