"""Best-fit packing with exact complements.

Documents become token ids plus one end id; only those longer than a sequence are cut, into full pieces after a first one
that may be shorter. What is packed is the histogram of piece lengths, which has at most `capacity` entries however
large the corpus is, so the plan is made on the driver:

1. from the longest length down, the gap that a piece leaves is looked up among the available lengths, their pair sums and
   their triple sums; a combination that fills it exactly is used as often as its members' counts allow;
2. what has no exact complement is placed by best fit, longest first, again by counts.

The plan lists, for each length, intervals of ranks with their first sequence number and offset. A piece finds its place by
its rank among the pieces of its length, which two-level counting gives without collecting a length's pieces in one task.

Step 1 can spend short pieces that later gaps need, so the plan is made several times: with combinations of up to one, two or
three members, and with pieces below some length kept for step 2. The plan of fewest sequences is taken.

Ids are those of the `tokenizers` file byte_bpe_50k.json. They are made with `tiktoken` from the same vocabulary's rank
file, which gives equal ids (a test holds the two against each other) in about a fifth of the time; texts are cut at the
strings of the file's added tokens first, which get their ids, as `tokenizers` does by default.

Defined results: a null text is the end id alone, repeated rows are packed each on their own, an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import checkpointed, gapless_rank, table

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict = {}


def encoder(path: str):
    """A tiktoken encoding from a rank file, one for each Python worker."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> dict[str, int]:
    """Strings that a tokenizer file gives ids of their own, beside its vocabulary."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def with_added(encode: Callable[[str], list[int]], added: dict[str, int]) -> Callable[[str], list[int]]:
    """An encoder that gives the added tokens' strings their ids, and the stretches between them those of `encode`."""
    if not added:
        return encode
    cut_at = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

    def ids(text: str) -> list[int]:
        if not any(s in text for s in added):
            return encode(text)
        return [i for part in cut_at.split(text) if part for i in ([added[part]] if part in added else encode(part))]

    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n > 0 ids: full ones at the end, the first takes the rest."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. `vocabulary` has the ranks, `tokenizer` the added tokens."""
    path, added = vocabulary or default_vocabulary(), added_tokens(tokenizer or default_tokenizer())

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = with_added(encoder(path).encode_ordinary, added)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut_batches, PIECES)


class _Plan:
    """Bins of equal contents, as (lengths in order, how many).

    members: how many pieces may fill a gap exactly; least: the shortest of them where there are several.
    """

    def __init__(self, counts: dict[int, int], capacity: int, members: int = 3, least: int = 1):
        self.capacity, self.members, self.least = capacity, members, least
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.bins: list[tuple[list[int], int]] = []
        self._exact()
        self._best_fit()

    def size(self) -> int:
        return sum(n for _, n in self.bins)

    def _use(self, lengths: list[int]) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min(int(self.left[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.left[x] -= n * k
        self.bins.append((lengths, n))

    def _pair(self, total: int, most: int) -> list[int] | None:
        """The pair with the given sum whose longer member is longest."""
        low = (total + 1) // 2
        high = min(most, total - self.least)
        if high < low:
            return None
        longer = np.arange(high, low - 1, -1)
        shorter = total - longer
        there = (self.left[longer] > 0) & (self.left[shorter] > np.where(longer == shorter, 1, 0))
        k = int(np.argmax(there))
        return [int(longer[k]), int(shorter[k])] if there[k] else None

    def _triple(self, total: int, most: int) -> list[int] | None:
        for a in range(min(most, total - 2 * self.least), (total + 2) // 3 - 1, -1):
            if self.left[a] > 0:
                self.left[a] -= 1
                pair = self._pair(total - a, a)
                self.left[a] += 1
                if pair:
                    return [a, *pair]
        return None

    def _exact(self) -> None:
        self.bins += [([self.capacity], int(self.left[self.capacity]))] if self.left[self.capacity] else []
        self.left[self.capacity] = 0
        for length in range(self.capacity - 1, 0, -1):
            gap = self.capacity - length
            while self.left[length] > 0:
                self.left[length] -= 1
                found = [gap] if self.left[gap] > 0 and self.members else (self.members > 1 and self._pair(gap, length)) or (self.members > 2 and self._triple(gap, length))
                self.left[length] += 1
                if not found:
                    break
                self._use([length, *found])

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
        for length in range(self.capacity - 1, 0, -1):
            n = int(self.left[length])
            while n:
                gap = next((g for g in range(length, self.capacity) if room.get(g)), None)
                if gap is None:
                    each = self.capacity // length
                    for k, m in ((each, n // each), (n % each, 1)):
                        if k and m:
                            room[self.capacity - k * length].append(([length] * k, m))
                    n = 0
                else:
                    held, m = room[gap].pop()
                    each = min(gap // length, max(1, n // m))
                    used = min(m, n // each)
                    if used < m:
                        room[gap].append((held, m - used))
                    room[gap - each * length].append((held + [length] * each, used))
                    n -= used * each
            self.left[length] = 0
        self.bins += [x for kept in room.values() for x in kept]


def best_plan(counts: dict[int, int], capacity: int) -> _Plan:
    """The plan of fewest sequences over the kinds of combinations; the first of equals, and none beyond a perfect one."""
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = None
    for members, least in [(3, 1), (3, capacity // 64), (3, capacity // 16), (2, 1), (2, capacity // 16), (2, capacity // 6), (1, 1), (0, 1)]:
        made = _Plan(counts, capacity, members, max(1, least))
        if best is None or made.size() < best.size():
            best = made
        if best.size() <= bound:
            break
    return best


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Intervals of ranks: length, first rank, first sequence number, offset in the sequence; sorted by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, n in best_plan(counts, capacity).bins:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], base, offset))
            used[x] += n
            offset += x
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces. `cut_pieces` is read several times, so give it checkpointed."""
    counts = dict(cut_pieces.groupBy("length").count().collect())  # at most `capacity` rows
    places = plan(counts, capacity)
    spark = cut_pieces.sparkSession
    # as many buckets as rows in each: neither numbering a bucket nor summing the buckets of a length meets many rows
    many = spark.createDataFrame([(k, max(1, int(n**0.5))) for k, n in counts.items()], "length long, buckets long")
    rows = cut_pieces.join(F.broadcast(many), "length").withColumn("bucket", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32), buckets)")).drop("buckets")
    ranked = gapless_rank(rows, "length", "bucket", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank")
    key = places["length"] << 44 | places["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(key, length << 44 | rank, "right") - 1
            found = {"sequence_id": places["sequence"][k] + rank - places["rank"][k], "offset": places["offset"][k]}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *map(pa.array, found.values())], ["doc_id", "piece", "start", "length", "ids_crc32", *found])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(checkpointed(pieces(table(spark, sf_dir, "documents"))))
