"""Suffix-array removal of repeated passages.

A byte is removed if it is covered by a string of `length` bytes that also starts in a document with a smaller id. Which
strings repeat is decided by suffix arrays; a lossless filter in front keeps text that can't repeat out of them:

1. Anchors. Of the 24-byte grams in a window of `length` bytes, the one with the least hash is the window's anchor; equal
   windows have equal anchors, so each window has one place to meet its equals. Documents are dealt into shards by id; each
   shard sends the hashes of its anchors once (twice where two of its documents have it), and gets those back that two
   documents have. Neighbouring windows with the same anchor form a run; only runs of shared anchors go on.
2. A suffix array for each shard, by Larsson-Sadakane refinement: ranks by the first 5 bytes, then by 10, 20, 40 and
   `length`, sorting only what isn't single yet. Common prefixes of neighbours, with Kasai's bound from the position before,
   tell where equal strings end, and with that each string's least id in the shard. Windows that a smaller id of the shard
   has are settled; the others go on to their anchor's bucket, in runs. (An anchor that very many documents have is dealt out
   by window instead, so no passage or its borders overload a bucket.)
3. Merging across shards. A bucket's runs are cut into parts of some shards each. Each part's suffix array gives its sorted
   different strings; they are looked up by binary search, eight bytes at a time, in the sorted strings of the parts before
   and merged into them. That gives each string its least id, and so the windows that a smaller id has.
4. Spans go back to the documents' shards and are applied to the texts.

An array's text has each run of bytes once, however many documents have it; its windows count with the least of their ids,
and all documents are judged by the array's strings. A shard's array, too, is cut into parts of at most PART_BYTES which are
merged, and runs whose anchor the shard has only once need no place in it.

Shards and buckets are sized by bytes, so their number grows with the corpus and their size doesn't.

Defined results: a null text is empty; texts shorter than `length` stay; a null id counts as larger than any other, and rows
with equal ids don't take bytes from each other; repeated rows have equal results; an empty table gives an empty result.
Extra columns are kept by `remove_repeats`, whose texts lose bytes of cut characters and get a new n_chars.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import by_shard, checkpointed, shards_for, table, text_bytes

LENGTH = 50
GRAM = 24
BYTES_PER_SHARD = 8 << 20
HOT_DOCUMENTS = 2000
PART_BYTES = 1 << 21
MOST_WINDOWS = 4096  # in a run
NULL_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BITS = 21  # of a position in a part; two ranks and a position make one 64-bit number
_BYTES = np.array([1 << 8 * k for k in range(8)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        k = min(have, n - have)
        out[have : have + k] = out[:k] * np.uint64(pow(base, have, 1 << 64))
        have += k
    return out


_CHUNK = 1 << 16
_UP = _powers(_BASE, _CHUNK + 256)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 256)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    n = len(data) - GRAM + 1
    out = np.empty(max(0, n), np.uint64)
    for at in range(0, n, _CHUNK):
        part = data[at : at + _CHUNK + GRAM - 1].astype(np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * _UP[: len(part)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(part) - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out[at : at + len(h)] = h
    return out


def runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: first window, one past the last window, and the anchor's hash."""
    windows = len(data) - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, wide, want = gram_hashes(data), 1, length - GRAM + 1
    while 2 * wide <= want:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < want:
        least = np.minimum(least[: wide - want], least[want - wide :])
    new = np.concatenate([[True], least[1:] != least[:-1]])
    first = np.flatnonzero(new)
    gaps = np.diff(np.append(first, windows))
    if gaps.max() > MOST_WINDOWS:  # a text that repeats itself byte by byte
        new[np.concatenate([np.arange(f, f + g, MOST_WINDOWS) for f, g in zip(first[gaps > MOST_WINDOWS], gaps[gaps > MOST_WINDOWS], strict=True)])] = True
        first = np.flatnonzero(new)
    return first, np.append(first[1:], windows), least[first]


class _Shard:
    """The runs of a shard's documents; equal rows count once."""

    def __init__(self, ids: list, texts: list, length: int):
        self.raw: dict[int, bytes] = {}
        self.order: dict[int, int] = {}
        for i, t in zip(ids, texts, strict=True):
            raw = (t or "").encode()
            self.order[key := row_key(i, raw)] = order_of(i)
            self.raw[key] = raw
        self.keys = np.array(list(self.raw), np.int64)
        self.data = np.frombuffer(b"".join(self.raw.values()), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(r) for r in self.raw.values()])]).astype(np.int64)
        found = [runs(self.data[a:b], length) for a, b in zip(self.begin, self.begin[1:], strict=False)]
        self.owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        self.first = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])
        self.last = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
        self.anchor = np.concatenate([np.zeros(0, np.uint64), *[f[2] for f in found]]) >> np.uint64(4)
        self.of_docs = [f[2] for f in found]

    def order_of_runs(self) -> np.ndarray:
        return np.array(list(self.order.values()), np.int64)[self.owner]


def row_key(doc_id: int | None, raw: bytes) -> int:
    """Every id is a seed of its own; for none, the text gets an end that no UTF-8 text has."""
    return (xxhash.xxh64_intdigest(raw + b"\xff", 0) if doc_id is None else xxhash.xxh64_intdigest(raw, doc_id % (1 << 64))) - (1 << 63)


def order_of(doc_id: int | None) -> int:
    """Where a row stands among the ids: null after all of them, so these stand one lower than they are."""
    return NULL_ID if doc_id is None else max(doc_id - 1, -(1 << 63))


def _shard_column(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))), F.lit(shards)).cast("int")


def _groups(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    if not len(values):
        return []
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return [(int(values[a]), int(a), int(b)) for a, b in zip(first, np.append(first[1:], len(values)), strict=True)]


def _anchor_sender(buckets: int, length: int):
    def send(docs: pa.Table) -> pa.Table:
        """Anchor hashes by bucket; the low four bits hold how many of the shard's documents have it, as a power of two."""
        s = _Shard(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), length)
        each = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, s.of_docs)])) >> np.uint64(4)
        first = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])) if len(each) else np.zeros(0, np.int64)
        anchor, n = each[first], np.diff(np.append(first, len(each)))
        value = anchor << np.uint64(4) | np.minimum(15, np.ceil(np.log2(n))).astype(np.uint64)
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        value, found = value[order], _groups(bucket[order])
        me = docs.column("shard")[0].as_py() if docs.num_rows else 0
        return pa.table({"bucket": pa.array([b for b, _, _ in found], pa.int64()), "shard": pa.array([me] * len(found), pa.int32()), "anchors": pa.array([value[a:b].tobytes() for _, a, b in found], pa.binary())})

    return send


def _share(blobs: pa.Table) -> pa.Table:
    """Of a bucket's anchors those of two documents or more, sent back to each shard that has them; the lowest bit marks hot ones."""
    lists = [np.frombuffer(b, np.uint64) for b in blobs.column("anchors").to_pylist()]
    every = np.sort(np.concatenate(lists))
    anchor, first = np.unique(every >> np.uint64(4), return_index=True)
    total = np.add.reduceat(2.0 ** (every & np.uint64(15)).astype(float), first)
    anchor, total = anchor[total > 1], total[total > 1]
    shard, back = [], []
    for s, values in zip(blobs.column("shard").to_pylist(), lists, strict=True):
        own = values >> np.uint64(4)
        at = np.minimum(np.searchsorted(anchor, own), max(0, len(anchor) - 1))
        there = anchor[at] == own if len(anchor) else np.zeros(len(own), bool)
        if there.any():
            shard.append(s)
            back.append((own[there] << np.uint64(1) | (total[at[there]] > HOT_DOCUMENTS).astype(np.uint64)).tobytes())
    return pa.table({"shard": pa.array(shard, pa.int32()), "shared": pa.array(back, pa.binary())})


_SENT = "bucket long, shard int, runs binary, spans binary"


def pack_spans(row: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> bytes:
    """Spans as bytes; overlapping and touching ones of a row become one."""
    order = np.lexsort((begin, row))
    row, begin, stop = row[order], begin[order], stop[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (begin[1:] > stop[:-1])]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(stop, first) if len(first) else stop
    return np.column_stack([row[first], begin[first], stop]).astype(np.int64).tobytes()


def _run_sender(buckets: int, length: int):
    def send(docs: pa.Table, shared: pa.Table) -> pa.Table:
        """Runs by bucket, and in one more row the spans that equal runs in this shard already settle."""
        out: dict[str, list] = {k: [] for k in ("bucket", "shard", "runs", "spans")}
        if docs.num_rows and shared.num_rows:
            s = _Shard(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), length)
            known = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in shared.column("shared").to_pylist()]))
            at = np.minimum(np.searchsorted(known, s.anchor << np.uint64(1)), len(known) - 1)
            kept = np.flatnonzero(known[at] >> np.uint64(1) == s.anchor)
            hot = known[at[kept]] & np.uint64(1) == 1
            text, first, last, owner, meet = s.data.tobytes(), s.first[kept], s.last[kept], s.owner[kept], s.anchor[kept]
            order, windows = s.order_of_runs()[kept], last - first
            beaten = np.zeros(int(windows.sum()), bool)
            _, back, n = np.unique(meet, return_inverse=True, return_counts=True)
            twice = n[back] > 1  # else no other window of the shard is equal
            some = np.flatnonzero(twice)
            if len(some):  # neighbouring runs of a document are one text, of about a megabyte at most
                new = np.concatenate([[True], (owner[some[1:]] != owner[some[:-1]]) | (first[some[1:]] != last[some[:-1]]) | (first[some[1:]] >> 20 != first[some[:-1]] >> 20)])
                a, b = some[new], some[np.append(np.flatnonzero(new)[1:] - 1, len(some) - 1)]
                begin = s.begin[owner[a]] + first[a]
                size = last[b] - first[a]
                content = [text[x:y] for x, y in zip(begin.tolist(), (begin + size + length - 1).tolist(), strict=True)]
                beaten[np.repeat(twice, windows)] = covered(order[a], size, content, length)
            k, low, high = stretches(beaten, windows)
            me, squeeze = docs.column("shard")[0].as_py(), zstandard.ZstdCompressor(1).compress
            out["bucket"].append(me % buckets)
            out["shard"].append(me)
            out["runs"].append(None)
            out["spans"].append(pack_spans(s.keys[owner[k]], first[k] + low, first[k] + high + length - 1))
            k, low, high = stretches(~beaten, windows)
            many = np.where(hot[k], high - low, 1)  # a hot anchor's windows go singly
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            k, low, high = (np.repeat(x, many) for x in (k, low, high))
            single = hot[k]
            low = low + np.where(single, step, 0)
            high = np.where(single, low + 1, high)
            begin = s.begin[owner[k]] + first[k] + low
            meet = meet[k]
            lone = np.flatnonzero(single)
            meet[lone] = [xxhash.xxh64_intdigest(text[x : x + length]) >> 4 for x in begin[lone].tolist()]
            bucket = (meet % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            k, low, high, begin, bucket = k[by_bucket], low[by_bucket], high[by_bucket], begin[by_bucket], bucket[by_bucket]
            head = np.column_stack([order[k], s.keys[owner[k]], first[k] + low, high - low]).astype(np.int64)
            for b, i, j in _groups(bucket):
                parts = [text[x:y] for x, y in zip(begin[i:j].tolist(), (begin[i:j] + high[i:j] - low[i:j] + length - 1).tolist(), strict=True)]
                out["bucket"].append(b)
                out["runs"].append(squeeze(np.int64(j - i).tobytes() + head[i:j].tobytes() + b"".join(parts)))
                out["shard"].append(me)
                out["spans"].append(None)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return send


class SuffixPart:
    """Suffix array of the windows of some runs: text, the windows' starts in it, and each window's document order."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int):
        self.text, self.length = np.concatenate([text, np.zeros(16, np.uint8)]), length
        rank = self._refine(len(text), starts, length)
        by_rank = np.argsort(rank)
        self.array = starts[by_rank]
        same = self._common_prefixes(self.array) >= length
        first = np.flatnonzero(np.concatenate([[True], ~same[1:]])) if len(starts) else np.zeros(0, np.int64)
        self.string = np.empty(len(starts), np.int64)  # for each window, which of the part's different strings it is
        self.string[by_rank] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(starts))))
        self.least = np.minimum.reduceat(order[by_rank], first) if len(first) else np.zeros(0, np.int64)
        self.at = self.array[first]  # one place of each different string, in the strings' order

    def _refine(self, n: int, starts: np.ndarray, length: int) -> np.ndarray:
        """Ranks of the windows by their first `length` bytes; equal windows have equal ranks."""
        if not len(starts):
            return np.zeros(0, np.int64)
        # what the later steps read: a step from h to h + g needs ranks by h at a position and g bytes on
        steps, h = [], 5
        while h < length:
            steps.append((h, g := min(h, length - h)))
            h += g
        need = [np.zeros(n, bool)]
        need[0][starts] = True
        for _, g in reversed(steps):
            more = need[0].copy()
            more[g:] |= need[0][:-g]
            need.insert(0, more)
        index = np.flatnonzero(need[0]).astype(np.uint64)
        key = np.zeros(len(index), np.uint64)
        for j in range(min(5, length)):
            key = key << np.uint64(8) | self.text[index + np.uint64(j)]
        key = np.sort(key << np.uint64(_BITS) | index)
        rank = np.zeros(n + 16, np.uint64)
        single = np.zeros(n + 16, bool)
        self._assign(key, np.zeros(len(key), np.uint64), rank, single)
        for (_, g), wanted in zip(steps, need[1:], strict=True):
            index = np.flatnonzero(wanted & ~single[:n]).astype(np.uint64)
            key = np.sort(rank[index] << np.uint64(2 * _BITS) | rank[index + np.uint64(g)] << np.uint64(_BITS) | index)
            fresh = rank.copy()
            self._assign(key, key >> np.uint64(2 * _BITS), fresh, single)
            rank = fresh
        return rank[starts].astype(np.int64)

    @staticmethod
    def _assign(key: np.ndarray, base: np.ndarray, rank: np.ndarray, single: np.ndarray) -> None:
        """From sorted (old rank, rank further on, index): a group's new rank is its old one plus its place in it."""
        index = (key & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        value = key >> np.uint64(_BITS)
        new = np.concatenate([[True], value[1:] != value[:-1]])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        outer = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        offset = first[group] - np.repeat(outer, np.diff(np.append(outer, len(base))))
        rank[index] = base + offset.astype(np.uint64)
        single[index] = (np.diff(np.append(first, len(key))) == 1)[group]

    def _common_prefixes(self, array: np.ndarray) -> np.ndarray:
        """Common prefix, up to `length`, of each window with the one before it in the array.

        In text order a prefix is at least the one of the position before less one (Kasai), as long as that one isn't cut
        off at `length` and the window after its neighbour is in the array too. So every second position is compared from
        the start, and the others from that bound.
        """
        n = len(array)
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        words = _words(self.text)
        before = np.concatenate([array[:1], array[:-1]])
        lookup = np.full(len(self.text), -1, np.int64)
        lookup[array] = np.arange(n)
        positions = np.flatnonzero(lookup >= 0)
        place = lookup[positions]
        there = np.zeros(len(self.text) + 1, bool)
        there[positions] = True
        odd = np.concatenate([[False], positions[1:] == positions[:-1] + 1]) & (np.arange(n) % 2 == 1)
        known = np.zeros(n, np.int64)
        for some in (~odd, odd):
            at = np.flatnonzero(some & (place > 0))
            done = np.zeros(len(at), np.int64)
            if some is odd:
                bound = (known[at - 1] < self.length) & (place[at - 1] > 0) & there[before[place[at - 1]] + 1]
                done[bound] = np.maximum(0, known[at[bound] - 1] - 1)
            a, b = positions[at], before[place[at]]
            open_ = np.arange(len(at))
            while len(open_):
                unlike = words(a[open_] + done[open_]) ^ words(b[open_] + done[open_])
                done[open_] = np.minimum(self.length, done[open_] + 8 - np.searchsorted(_BYTES, unlike, "right"))
                open_ = open_[(unlike == 0) & (done[open_] < self.length)]
            known[at] = done
        out[place] = known
        out[0] = 0
        return out


def _words(text: np.ndarray):
    """For positions: the eight bytes from there on as a number in the order of the bytes (the last ones, past the end)."""
    view = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    return lambda at: view[np.minimum(at, len(view) - 1)].astype(np.uint64)


class SortedStrings:
    """The different strings of several parts in order, each with a number that stays, and its least document order."""

    def __init__(self, length: int):
        self.length, self.text, self.n = length, np.zeros(16, np.uint8), 0
        self.at, self.number, self.least = (np.zeros(0, np.int64),) * 3
        self.lead = np.zeros(0, np.uint64)

    def word(self, text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes k to k + 7 of the strings at some positions of a text; bytes past `length` are zero."""
        out = _words(text)(at + k)
        past = np.uint64(8 * max(0, k + 8 - self.length))
        return out >> past << past

    def find(self, part: SuffixPart) -> tuple[np.ndarray, np.ndarray]:
        """For each string of the part its place here, and if it is there: binary search, narrowed eight bytes at a time."""
        asked = self.word(part.text, part.at, 0)
        low, high = np.searchsorted(self.lead, asked), np.searchsorted(self.lead, asked, "right")
        for k in range(8, self.length, 8):
            some = np.flatnonzero(low < high)
            if not len(some):
                break
            asked = self.word(part.text, part.at[some], k)
            bounds = []
            for less in (np.less, np.less_equal):
                a, b = low[some], high[some]
                open_ = np.flatnonzero(a < b)
                while len(open_):
                    middle = (a[open_] + b[open_]) >> 1
                    up = less(self.word(self.text, self.at[middle], k), asked[open_])
                    a[open_] = np.where(up, middle + 1, a[open_])
                    b[open_] = np.where(up, b[open_], middle)
                    open_ = open_[a[open_] < b[open_]]
                bounds.append(a)
            low[some], high[some] = bounds
        return low, low < high

    def merge(self, part: SuffixPart) -> np.ndarray:
        """The numbers of the part's strings; new ones are put in their places."""
        place, there = self.find(part) if self.n else (np.zeros(len(part.at), np.int64), np.zeros(len(part.at), bool))
        numbers = np.empty(len(part.at), np.int64)
        numbers[there] = self.number[place[there]]
        fresh = np.flatnonzero(~there)
        numbers[fresh] = self.n + np.arange(len(fresh))
        self.least[numbers[there]] = np.minimum(self.least[numbers[there]], part.least[there])
        self.least = np.concatenate([self.least, part.least[fresh]])
        self.lead = np.insert(self.lead, place[fresh], self.word(part.text, part.at[fresh], 0))
        self.at = np.insert(self.at, place[fresh], part.at[fresh] + len(self.text))
        self.number = np.insert(self.number, place[fresh], numbers[fresh])
        self.text = np.concatenate([self.text, part.text])
        self.n += len(fresh)
        return numbers


def covered(order: np.ndarray, windows: np.ndarray, content: list[bytes], length: int, part_bytes: int = 0) -> np.ndarray:
    """For each window of some runs if a smaller order has it, run after run.

    Runs are given by their document's order, number of windows and bytes. The different ones are cut into parts of at most
    part_bytes, or one run; the parts' strings are merged.
    """
    part_bytes = part_bytes or PART_BYTES
    known: dict[bytes, int] = {}
    classes = np.fromiter((known.setdefault(c, len(known)) for c in content), np.int64, len(content))
    texts = list(known)
    del known
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, classes, order)
    size = np.array([len(t) for t in texts], np.int64)
    n = size - length + 1
    begin, ends = np.cumsum(n) - n, np.concatenate([[0], np.cumsum(size)])
    strings, parts, at = SortedStrings(length), [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + part_bytes, "right")) - 1)
        own, offset = n[at:end], ends[at:end] - ends[at]
        starts = np.repeat(offset - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        part = SuffixPart(np.frombuffer(b"".join(texts[at:end]), np.uint8), starts, np.repeat(least[at:end], own), length)
        parts.append((part.string, strings.merge(part)))
        at = end
    best = np.concatenate([np.zeros(0, np.int64), *[strings.least[numbers][string] for string, numbers in parts]])
    run = np.repeat(np.arange(len(order)), windows)
    step = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    return best[begin[classes[run]] + step] < order[run]


def stretches(flags: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of flagged windows within the runs: run, first window and one past the last."""
    offset = np.cumsum(windows) - windows
    before = np.concatenate([[False], flags[:-1]])
    before[offset[windows > 0]] = False
    begin = np.flatnonzero(flags & ~before)
    after = np.concatenate([flags[1:], [False]]) if len(flags) else flags
    after[(offset + windows - 1)[windows > 0]] = False
    end = np.flatnonzero(flags & ~after)
    run = np.repeat(np.arange(len(windows)), windows)[begin]
    return run, begin - offset[run], end + 1 - offset[run]


def _judge(length: int):
    def judge(blobs: pa.Table) -> pa.Table:
        """Spans by shard, from a bucket's runs; those that were settled before are handed on."""
        shard, spans, heads, shards, content = [], [], [], [], []
        for s, blob, settled in zip(blobs.column("shard").to_pylist(), blobs.column("runs").to_pylist(), blobs.column("spans").to_pylist(), strict=True):
            if settled is not None:
                shard.append(s)
                spans.append(settled)
                continue
            raw = zstandard.decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            head = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(n, 4)
            ends = (8 + 32 * n + np.cumsum(head[:, 3] + length - 1)).tolist()
            content.append([raw[a:b] for a, b in zip([8 + 32 * n, *ends], ends, strict=False)])
            heads.append(head)
            shards.append(s)
        if heads:
            by_home = np.argsort(shards, kind="stable").tolist()  # so a part is of some shards
            head, home = np.concatenate([heads[k] for k in by_home]), np.repeat(np.array(shards)[by_home], [len(heads[k]) for k in by_home])
            lost = covered(head[:, 0], head[:, 3], [c for k in by_home for c in content[k]], length)
            run, low, high = stretches(lost, head[:, 3])
            begin, stop = head[run, 2] + low, head[run, 2] + high + length - 1
            for s, i, j in _groups(home[run]):
                shard.append(s)
                spans.append(pack_spans(head[run[i:j], 1], begin[i:j], stop[i:j]))
        return pa.table({"shard": pa.array(shard, pa.int32()), "spans": pa.array(spans, pa.binary())})

    return judge


def repeat_spans(docs: DataFrame, length: int = LENGTH, bytes_per_shard: int = BYTES_PER_SHARD) -> tuple[DataFrame, int]:
    """(shard, spans): spans to remove, as pack_spans has them, by the shard of their rows; and the number of shards."""
    shards = shards_for(text_bytes(docs), bytes_per_shard)
    dealt = by_shard(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _shard_column(shards).alias("shard")), shards)
    anchors = dealt.groupBy("shard").applyInArrow(_anchor_sender(shards, length), "bucket long, shard int, anchors binary")
    shared = checkpointed(by_shard(anchors, shards, "bucket").groupBy("bucket").applyInArrow(_share, "shard int, shared binary"))
    sent = dealt.groupBy("shard").cogroup(by_shard(shared, shards).groupBy("shard")).applyInArrow(_run_sender(shards, length), _SENT)
    spans = checkpointed(by_shard(sent, shards, "bucket").groupBy("bucket").applyInArrow(_judge(length), "shard int, spans binary"))
    return by_shard(spans, shards), shards


def merge_spans(begin: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of overlapping or touching ones."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(begin, kind="stable").tolist():
        a, b = int(begin[k]), int(stop[k])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _with_spans(docs: pa.Table, spans: pa.Table):
    """(raw text, maximal spans) of each row."""
    row, begin, stop = np.frombuffer(b"".join(spans.column("spans").to_pylist()), np.int64).reshape(-1, 3).T
    order = np.argsort(row, kind="stable")
    row, begin, stop = row[order], begin[order], stop[order]
    for doc_id, text in zip(docs.column("doc_id"), docs.column("text"), strict=True):
        raw = (text.as_py() or "").encode()
        key = row_key(doc_id.as_py(), raw)
        a, b = np.searchsorted(row, key), np.searchsorted(row, key, "right")
        yield raw, merge_spans(begin[a:b], stop[a:b])


def _digest(docs: pa.Table, spans: pa.Table) -> pa.Table:
    out: list[tuple] = []
    for raw, found in _with_spans(docs, spans):
        out.append((len(raw), sum(b - a for a, b in found), len(found), hashlib.sha256(cut_out(raw, found)).hexdigest()))
    cols = list(zip(*out, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), **{k: pa.array(c, t) for k, c, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, kinds, strict=True)}})


def remove_repeats(docs: DataFrame, length: int = LENGTH, bytes_per_shard: int = BYTES_PER_SHARD) -> DataFrame:
    """The rows of `docs` without the repeated bytes of their texts; a character that is cut goes whole. n_chars follows."""
    spans, shards = repeat_spans(docs, length, bytes_per_shard)
    names = docs.columns

    def clean(part: pa.Table, found: pa.Table) -> pa.Table:
        texts = [cut_out(raw, s).decode("utf-8", "ignore") if s else None for raw, s in _with_spans(part, found)]
        old = part.column("text")
        new = pa.chunked_array([pa.array([o.as_py() if n is None else n for o, n in zip(old, texts, strict=True)], pa.string())])
        columns = {c: part.column(c) for c in names} | {"text": new}
        if "n_chars" in names:
            sizes = [n if t is None else len(t) for n, t in zip(part.column("n_chars").to_pylist(), texts, strict=True)]
            columns["n_chars"] = pa.chunked_array([pa.array(sizes, pa.int64())])
        return pa.table(columns)

    shard = "__shard"
    dealt = by_shard(docs.withColumn(shard, _shard_column(shards)), shards, shard)
    return dealt.groupBy(shard).cogroup(spans.groupBy("shard")).applyInArrow(clean, docs.schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans, shards = repeat_spans(docs)
    dealt = by_shard(docs.withColumn("shard", _shard_column(shards)), shards)
    return dealt.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
