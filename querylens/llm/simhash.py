"""SimHash near-duplicates, linked by vantage-point trees.

Fingerprints: words of the lower-cased text, shingles of neighbouring words, XXH64 of each shingle, and for each of the 64
bits the majority over all shingles. Fingerprints within `radius` differing bits are linked; a component's id is the least
document id that links reach.

Links are exact, and each comes out of a vantage-point tree. Equal fingerprints are one point, whatever number of documents
share it. A tree splits points by their Hamming distance to a vantage point, and looks for pairs across the boundary only
where the triangle inequality leaves them possible: both within `radius` of it. Over all 64 bits that prunes a bounded share
(distances of unrelated fingerprints lie within a few bits of 32), so work would grow with the square of the points. So a
lossless filter stands in front: of radius + k blocks of bits at most `radius` hold a difference, so two linked points agree
on (have distance 0 in) at least k blocks, and so on any part of these. Each choice of k blocks deals the points into trees
by so many of their bits that a tree of unrelated points holds about POINTS_PER_KEY; the number of bits and k grow with the
points, which changes the work but never the links.

Alike points (many near copies) can still crowd one tree. Beyond POINTS_PER_TASK its points are split over tasks by rings of
distance to a vantage point, radius + 1 wide; linked points lie in the same or neighbouring rings, so each ring's task gets
the ring before it as well. Pieces that are still too large are split again around another point, RING_LEVELS times at most.
A tree hands on only a spanning forest of its links.

`hashes` > 1 takes that many fingerprints of each text, from as many mixes of its shingles' hashes; texts are linked if one
pair of fingerprints is within `radius`. Bits only estimate a similarity (Jaccard, of shingle sets): at 0.8 about 10 of 64
differ, give or take 3. So with a `similarity` the shingle sets themselves decide, and `radius` and `hashes` aren't read.

Texts of equal sets are one point. In any total order of shingles two sets of similarity t share one of each set's first
n - ceil(t n) + 1, so only these are dealt out. Of these a pair must share as many as its similarity needs with all that is
not dealt out in common (no link is lost), and each such pair is decided by the exact Jaccard of its sets.
The order puts shingles common in a sample last, which keeps candidates few and changes no link. Shingles that the same points share are one key that counts so many times.
Links come from vantage-point trees first: each key's points make a tree for each of their `hashes` fingerprints, every point is
taken with the least one that lies within `radius`, and exact Jaccard follows. Fingerprints only estimate the similarity, so keys
whose points are not in one component by then are gone through pair by pair, and no similar pair is lost. Each point
carries the parities of its shingles in PARITIES classes: two sets differ in at least as many shingles as they have
parities that differ, so a pair with too many goes before it leaves its task, and no similar one does. Sets are of 64-bit
hashes.

Shards hold a range of leaves each and are sized by count. Components come from alternating large-star and small-star rounds
over checkpointed link tables; no links, components or fingerprints are collected.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text of fewer words than a shingle
is one shingle; repeated rows share their component; null ids get a component id only through others' ids (null if there
are none); an empty table gives an empty result. Extra columns are not read by the query and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import arrays, by_shard, checkpointed, table

SHINGLE = 4
RADIUS = 4
SEED = 42
POINTS_PER_SHARD = 20_000
POINTS_PER_LEAF = 64
POINTS_PER_KEY = 1024  # unrelated points of a tree
POINTS_PER_TASK = 50_000  # larger trees are split by rings
RING_LEVELS = 4
MOST_PAIRS = 2_000_000
SAMPLED = 16  # common shingles are counted in one of so many texts
COMMON, MOST_COMMON = 8, 500_000  # sampled texts with a common shingle, and how many shingles are taken as common
ROWS_PER_SHARD = 200_000
KEY_ROWS_PER_SHARD = 50_000  # of keys with their points
PARITIES = 1024  # a multiple of 64
PAIRS_AT_ONCE = 100_000
SETS_AT_ONCE = 500
MANY = 8  # points of a key that make a tree of several levels; fewer are one leaf
SLOTS = 1 << 23  # of the filter that candidates' sets pass; fewer let more sets by
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of each shingle, repeats kept; none of a wordless text."""
    words = (text or "").encode().translate(_UPPER).split()  # bytes split at just the ASCII white space that counts here
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    last = ends[-n:].tolist()
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), last, strict=True)), np.uint64, n)


def simhash(text: str | None, shingle: int = SHINGLE, hashes: int = 1) -> list[int]:
    """`hashes` fingerprints; the first is that of the plain XXH64 values."""
    h = shingle_hashes(text, shingle)
    n = len(h)
    if not n:
        return [0] * hashes
    out = []
    for k in range(hashes):
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = h[at : at + (1 << 16)]
            part = _mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else part
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big"))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def names(hashes: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, hashes))]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: tuple[str, ...] = ("doc_id",), hashes: int = 1) -> DataFrame:
    """The key columns and fp, fp1, ...: the fingerprints as signed longs; with more than one also `shingles`, the set."""
    rows = docs.select(*keys, "text")
    n = len(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    fps = names(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(x.as_py(), shingle, hashes) for x in batch.column(n)], np.uint64).reshape(-1, hashes).view(np.int64)
            sets = [_lists(batch.column(n), shingle)] if hashes > 1 else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(fp[:, k].copy()) for k in range(hashes)), *sets], [*keys, *fps, "shingles"][: n + hashes + len(sets)])

    return rows.mapInArrow(run, schema + "".join(f", {c} long" for c in fps) + ", shingles array<long>" * (hashes > 1))


def over_sets(rows: DataFrame, shingle: int | None, each: Callable[[list, pa.Array, list], pa.RecordBatch], schema: str) -> DataFrame:
    """each(columns before the last, shingle sets, their nodes), some rows at a time, in the task that makes the sets.

    The last column has texts, or with no `shingle` the sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SETS_AT_ONCE):
                *columns, last = batch.slice(at, SETS_AT_ONCE).columns
                sets = last if shingle is None else _lists(last, shingle)
                offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
                node = [xxhash.xxh64_intdigest(values[i:j].tobytes()) - (1 << 63) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield each(columns, sets, node)

    return rows.mapInArrow(run, schema)


def _lists(texts: pa.Array, shingle: int) -> pa.Array:
    sets = [np.unique(shingle_hashes(x.as_py(), shingle).view(np.int64)) for x in texts]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def set_fingerprints(offsets: np.ndarray, values: np.ndarray, hashes: int) -> np.ndarray:
    """A row of fingerprints for each shingle set, as `simhash` has them for texts whose shingles don't repeat."""
    size = np.diff(offsets)
    out = np.zeros((len(size), hashes), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    starts, h = offsets[some] - offsets[0], values[offsets[0] : offsets[-1]].view(np.uint64)
    for k in range(hashes):
        part = _mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else h
        ones = np.add.reduceat(np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), starts, axis=0, dtype=np.int32)
        out[some, k] = np.packbits(2 * ones > size[some, None], axis=1).view(">u8").ravel()
    return out


class VantagePointTree:
    """Pairs of points within a radius; points are distinct 64-bit numbers.

    A node's points are split at the median distance to its vantage point. Points of the two sides can be near only across
    the boundary: by the triangle inequality both must lie within `radius` of it. Leaves compare their points directly.
    """

    def __init__(self, points: np.ndarray, leaf: int = POINTS_PER_LEAF):
        self.points, self.leaf, self.held = points, leaf, 0

    def pairs(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the linked pairs' ends; of very many pairs a spanning forest stands for those found so far."""
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        todo = [(np.arange(len(self.points)), np.zeros(0, np.int64))]
        while todo:
            a, b = todo.pop()  # pairs within a, or between a and b where b has points
            if len(a) * (len(b) or len(a)) <= self.leaf * self.leaf:
                self._direct(a, b, radius, left, right)
                continue
            both = np.concatenate([a, b])
            vantage = self.points[both[len(both) // 2]]
            da = np.bitwise_count(self.points[a] ^ vantage)
            db = np.bitwise_count(self.points[b] ^ vantage)
            middle = int(np.median(np.concatenate([da, db])))
            near_a, far_a = a[da <= middle], a[da > middle]
            edge_a, edge_b = a[(da <= middle) & (da > middle - radius)], a[(da > middle) & (da <= middle + radius)]
            if not len(b):
                if not len(near_a) or not len(far_a):
                    self._direct(a, b, radius, left, right)
                    continue
                todo += [(near_a, b), (far_a, b)]
                self._between(edge_a, edge_b, len(a), radius, todo, left, right)
            else:
                near_b, far_b = b[db <= middle], b[db > middle]
                edge_near, edge_far = b[(db <= middle) & (db > middle - radius)], b[(db > middle) & (db <= middle + radius)]
                whole = len(a) * len(b)
                for x, y in ((near_a, near_b), (far_a, far_b), (edge_a, edge_far), (edge_b, edge_near)):
                    self._between(x, y, whole, radius, todo, left, right, products=True)
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2

    def _between(self, x, y, whole, radius, todo, left, right, products: bool = False) -> None:
        if not len(x) or not len(y):
            return
        if len(x) * len(y) <= self.leaf * self.leaf or products and len(x) * len(y) > 0.7 * whole or not products and len(x) + len(y) > 0.9 * whole:
            self._direct(x, y, radius, left, right)  # no boundary cuts such points apart
        else:
            todo.append((x, y))

    def _direct(self, a, b, radius, left, right) -> None:
        within = not len(b)
        b = a if within else b
        step = max(1, 2_000_000 // len(b))
        for at in range(0, len(a), step):
            near = np.bitwise_count(self.points[a[at : at + step], None] ^ self.points[b][None, :]) <= radius
            if within:
                near &= np.arange(len(b))[None, :] > np.arange(at, at + near.shape[0])[:, None]
            i, j = np.nonzero(near)
            i, j = a[at + i], b[j]
            if len(i):
                left.append(i)
                right.append(j)
                self.held += len(i)
        if self.held > MOST_PAIRS:
            root = roots(len(self.points), np.concatenate(left), np.concatenate(right))
            left[:] = [np.flatnonzero(root != np.arange(len(root)))]
            right[:] = [root[left[0]]]
            self.held = len(left[0])


def near_points(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of near pairs of distinct points, from trees; many points are dealt to these by each block of bits, of which near ones share one.

    A tree that holds more than POINTS_PER_KEY even so has a crowd: its points are linked with a vantage point each that is near.
    """
    if len(points) <= POINTS_PER_KEY:
        return VantagePointTree(points).pairs(radius)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shift, width in blocks(radius + 1):
        block = points >> np.uint64(shift) & np.uint64((1 << width) - 1)
        order = np.argsort(block, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0, [True]]))
        for f, g in zip(first.tolist(), first[1:].tolist(), strict=False):
            some = order[f:g]
            while len(some) > POINTS_PER_KEY:
                vantage = some[len(some) // 2]
                near = np.bitwise_count(points[some] ^ points[vantage]) <= radius
                left.append(np.full(int(near.sum()), vantage))
                right.append(some[near])
                some = some[~near]
            if len(some) > 1:
                a, b = VantagePointTree(points[some]).pairs(radius)
                left.append(some[a])
                right.append(some[b])
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n items the least item of its component, by label propagation with pointer jumping."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def blocks(n_blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of blocks that make up the 64 bits."""
    edges = [round(64 * k / n_blocks) for k in range(n_blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def agreeing(n_points: int, radius: int) -> int:
    """How many blocks a tree's points agree on: enough that one of unrelated points holds about POINTS_PER_KEY at most."""
    k = 1
    while k < 4 and n_points / 2 ** (64 * k / (radius + k)) > POINTS_PER_KEY:
        k += 1
    return k


def shard_links(points: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of links within the runs of equal keys, one for each point that isn't the first of its component in its tree."""
    order = np.lexsort((points, keys))
    points, keys = points[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for f, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        a, b = VantagePointTree(points[f : f + n]).pairs(radius)
        if len(a):
            root = roots(n, a, b)
            some = np.flatnonzero(root != np.arange(n))
            left.append(some + f)
            right.append(root[some] + f)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def ringed(dealt: DataFrame, radius: int) -> DataFrame:
    """Trees of more than POINTS_PER_TASK points split by rings of distance to one of their points."""
    for _ in range(RING_LEVELS):
        large = dealt.groupBy("choice", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("point").alias("vantage")).filter(F.col("n") > POINTS_PER_TASK)
        large = checkpointed(large.select("choice", "leaf", "vantage"))
        if large.isEmpty():
            break
        ring = F.floor(F.bit_count(F.col("point").bitwiseXOR(F.col("vantage"))) / (radius + 1))
        rings = F.explode(F.when(F.col("vantage").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array(ring, ring + 1))).alias("ring")
        # a key that large trees share with no other row: their number is at most the points' over POINTS_PER_TASK
        dealt = dealt.join(large, ["choice", "leaf"], "left").select("node", "point", "choice", "leaf", "vantage", rings)
        dealt = checkpointed(dealt.select("node", "point", "choice", F.when(F.col("ring") < 0, F.col("leaf")).otherwise(F.xxhash64("leaf", "vantage", "ring")).alias("leaf")))
    return dealt


def links(points: DataFrame, radius: int = RADIUS, points_per_shard: int = POINTS_PER_SHARD, hashes: int = 1) -> DataFrame:
    """Pairs (a, b) of linked points with the components of all links. `points` has distinct `node` and fingerprints; give it checkpointed."""
    n = points.count()
    k = agreeing(n, radius)
    parts = blocks(radius + k)
    bits = max(0, int(np.ceil(np.log2(max(1, n) / POINTS_PER_KEY) / k)))  # of each block
    fps = names(hashes)
    chosen = [(f, c) for f in range(hashes) for c in combinations(range(radius + k), k)]
    shards = max(1, -(-n * len(chosen) // points_per_shard))

    def leaf(f: int, c: tuple[int, ...]) -> Column:
        """The chosen blocks' bits, side by side."""
        out = F.lit(0).cast("long")
        for j in c:
            shift, width = parts[j]
            width = min(width, bits)
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fps[f], shift).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    dealt = points.select("node", F.posexplode(F.array(*[F.struct(F.col(fps[f]).alias("point"), leaf(f, c).alias("leaf")) for f, c in chosen])).alias("choice", "x"))
    dealt = ringed(dealt.select("node", "x.point", "choice", "x.leaf"), radius)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("choice", "leaf"), F.lit(shards)))

    def run(part: pa.Table) -> pa.Table:
        node, point = part.column("node").to_numpy(), part.column("point").to_numpy().view(np.uint64)
        choice, leaves = part.column("choice").to_numpy().astype(np.int64), part.column("leaf").to_numpy()
        key = np.unique(np.column_stack([choice, leaves]), axis=0, return_inverse=True)[1].ravel() if len(node) else leaves
        a, b = shard_links(point, key, radius)
        return pa.table({"a": node[a], "b": node[b]})

    return by_shard(dealt, shards).groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's least node.

    Large-star links each node's greater neighbours to its least one, small-star its lesser ones; both keep components and
    end in stars. Minima are aggregated with partial results and checkpointed, so that the joins with them have a plain
    exchange on either side and a node with very many links can be split; no node's neighbours are gathered.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct())
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = checkpointed(large)
        least = checkpointed(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")))
        small = large.join(least, "hi")
        small = small.select("hi", F.col("m").alias("lo")).union(small.filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        small = checkpointed(small)
        # a star forest: each node has one root, and no root has one
        if least.filter("n > 1").isEmpty() and large.join(least.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            return small.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        edges = small


def with_components(prints: DataFrame, radius: int = RADIUS, hashes: int = 1, similarity: float | None = None) -> DataFrame:
    """Add node, root and component_id to rows with doc_id and fingerprints, which should be given checkpointed.

    With a `similarity` the rows' shingle sets decide, exactly, and the fingerprints are made of these sets.
    """
    if similarity is not None:
        return with_set_components(prints.select(*[c for c in prints.columns if c != "shingles"], "shingles"), similarity, radius=radius, hashes=hashes)
    fps = names(hashes)
    node = F.col("fp") if hashes == 1 else F.xxhash64(*fps)
    points = checkpointed(prints.groupBy(*fps).agg(F.min("doc_id").alias("least")).withColumn("node", node))
    star = components(links(points.select("node", *fps), radius, hashes=hashes))
    grouped = points.select("node", "least").join(star, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    grouped = checkpointed(grouped)
    ids = checkpointed(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    by_point = checkpointed(grouped.select("node", "root").join(ids, "root"))
    return prints.withColumn("node", node).join(by_point, "node")


def common_shingles(sample: DataFrame, shingle: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in a sample, sorted, and their ranks from least to most common. They decide the work, no result."""

    def each(columns: list, sets: pa.Array, node: list) -> pa.RecordBatch:
        key, n = np.unique(sets.flatten().to_numpy(), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    found = over_sets(sample, shingle, each, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    key, n = arrays(found.orderBy(F.desc("n"), "key").limit(MOST_COMMON))
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((key, n))] = np.arange(len(key))
    order = np.argsort(key)
    return key[order], rank[order]


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set: a set of that similarity or more has one of them among its own first."""
    if not len(h):
        return h
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1
    at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
    last = common[at] == h if len(common) else np.zeros(len(h), bool)
    rare = h[~last]
    if len(rare) >= n:
        return rare[:n]
    return np.concatenate([rare, h[last][np.argsort(rank[at[last]])]])[:n]


def parities(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles is in each class; as longs."""
    odd = np.bincount(h & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def first_shingles(rows: DataFrame, shingle: int | None, sample: DataFrame, similarity: float, hashes: int = 1) -> DataFrame:
    """The node, size, parities, fingerprints and prefix of each row's shingle set in place of the last column."""
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(sample, shingle))
    names = [*rows.columns[:-1], "node", "size", "bits", "prints", "prefix"]

    def each(columns: list, sets: pa.Array, node: list) -> pa.RecordBatch:
        common, rank = shared.value
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        first = [prefix(values[i:j], similarity, common, rank) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
        bits = [parities(values[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        width = PARITIES // 64
        bits = pa.ListArray.from_arrays(pa.array((np.arange(len(bits) + 1) * width).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *bits])))
        prints = pa.ListArray.from_arrays(pa.array((np.arange(len(node) + 1) * hashes).astype(np.int32)), pa.array(set_fingerprints(offsets, values, hashes).view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([*columns, pa.array(node, pa.int64()), pa.array(np.diff(offsets).astype(np.int64)), bits, prints, lists], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return over_sets(rows, shingle, each, schema + ", node long, size long, bits array<long>, prints array<long>, prefix array<long>")


def shared_keys(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, node, keys) of keys with two nodes or more; `list` stands for a key's nodes, `keys` counts the keys with just these.

    Lists are known by 64-bit numbers, as sets are.
    """
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else np.zeros(0, bool)
    key, node = key[new], node[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(key)))
    if not (length > 1).any():
        return (np.zeros(0, np.int64),) * 3
    number = _mixed(np.add.reduceat(_mixed(node.view(np.uint64)), starts) + length.astype(np.uint64)).view(np.int64)
    several = np.flatnonzero(length > 1)
    number, first, keys = np.unique(number[several], return_index=True, return_counts=True)
    starts, length = starts[several[first]], length[several[first]]
    at = np.repeat(starts - np.cumsum(length) + length, length) + np.arange(length.sum())
    return np.repeat(number, length), node[at], np.repeat(keys, length)


def tree_pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray, bits: np.ndarray, prints: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each key every node with the least one that each fingerprint has within the radius, if sizes and parities allow the similarity.

    A key's nodes make a tree for each fingerprint; less than MANY of them are one leaf, and all such leaves are compared at once.
    """
    order = np.lexsort((node, key))
    new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(node[order]) != 0)]) if len(key) else np.zeros(0, bool)
    order = order[new]
    key, node, size, bits, prints = key[order], node[order], size[order], bits[order], prints[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(key)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def take(a: np.ndarray, b: np.ndarray) -> None:
        """Keeps of each second node the pair with the least first one."""
        fits = similar_enough(size, bits, a, b, similarity)
        a, b = a[fits], b[fits]
        order = np.lexsort((a, b))
        first = order[np.concatenate([[True], np.diff(b[order]) != 0])] if len(order) else order
        left.append(a[first])
        right.append(b[first])

    rest = np.repeat(starts + length, length) - np.arange(len(key))
    at, d = np.flatnonzero(np.repeat(length < MANY, length) & (rest > 1)), 1
    while len(at):
        near = at[(np.bitwise_count(prints[at] ^ prints[at + d]) <= radius).any(1)]
        take(near, near + d)
        d += 1
        at = at[rest[at] > d]
    for f, n in zip(starts[length >= MANY].tolist(), length[length >= MANY].tolist(), strict=True):
        for k in range(prints.shape[1]):
            points, first, back = np.unique(prints[f : f + n, k], return_index=True, return_inverse=True)
            a, b = near_points(points, radius)
            least = first[back]  # equal points' first one, and of others the least that is near
            np.minimum.at(least, np.maximum(first[a], first[b]), np.minimum(first[a], first[b]))
            paired = np.flatnonzero(least < np.arange(n))
            take(f + least[paired], f + paired)
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((a, b))
    first = order[np.concatenate([[True], np.diff(b[order]) != 0])] if len(order) else order
    return node[a[first]], node[b[first]]


def similar_enough(size: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sizes and parities of the sets a and b allow the similarity; some pairs at a time."""
    apart = (1 - similarity) / (1 + similarity)  # most that sets may differ in, of the sum of their sizes
    fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6
    sized = np.flatnonzero(fits)
    for at in range(0, len(sized), PAIRS_AT_ONCE):
        some = sized[at : at + PAIRS_AT_ONCE]
        x, y = a[some], b[some]
        fits[some] = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= apart * (size[x] + size[y]) + 1e-6
    return fits


def run_pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, keys: np.ndarray, bits: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Pairs of nodes with one key, of different roots and of sizes and parities that allow the similarity.

    Returned are the nodes, how many keys that one stands for (a pair comes once a key), and the sizes.
    """
    order = np.lexsort((node, size, key))
    key, node = key[order], node[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])) if len(key) else order
    keys = np.add.reduceat(keys[order], new) if len(new) else keys
    key, node, size, root, bits = key[new], node[new], size[order[new]], root[order[new]], bits[order[new]]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(key)))
    unsettled = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), length) if len(key) else np.zeros(0, bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = np.repeat(starts + length, length) - np.arange(len(key))
    at = np.flatnonzero(unsettled & (rest > 1))
    d = 1
    while len(at):
        at = at[size[at] >= similarity * size[at + d] - 1e-6]  # sizes rise, so what is too small stays so
        a = at[root[at] != root[at + d]]
        a = a[similar_enough(size, bits, a, a + d, similarity)]
        swapped = node[a] > node[a + d]
        left.append(np.where(swapped, a + d, a))
        right.append(np.where(swapped, a, a + d))
        d += 1
        at = at[rest[at] > d]
    a, b = np.concatenate(left), np.concatenate(right)
    return node[a], node[b], keys[a], size[a], size[b]


def tree_candidates(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Distinct pairs (a, b) of `tree_pairs` over the rows of each shard."""

    def run(part: pa.Table) -> pa.Table:
        wide = lambda c: part.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1)
        a, b = tree_pairs(*(part.column(c).to_numpy() for c in ("key", "node", "size")), wide("bits"), wide("prints"), similarity, radius)
        a, b = np.unique(np.column_stack([a, b]), axis=0).T
        return pa.table({"a": a, "b": b})

    return rows.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def candidate_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of `run_pairs` over the rows of each shard that share shingles enough.

    What two prefixes share and what follows the prefix that ends first is all that the sets can share.
    """

    def run(part: pa.Table) -> pa.Table:
        bits = part.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITIES // 64)
        a, b, n, x, y = run_pairs(*(part.column(c).to_numpy() for c in ("key", "node", "size", "root", "keys")), bits, similarity)
        order = np.lexsort((b, a))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])) if len(a) else order
        at = order[new]
        n = np.add.reduceat(n[order], new) if len(new) else n
        return pa.table({"a": a[at], "b": b[at], "n": n, "most": np.maximum(x, y)[at], "both": (x + y)[at]})

    found = rows.groupBy("shard").applyInArrow(run, "a long, b long, n long, most long, both long")
    found = found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.max("both").alias("both"))
    enough = F.col("n") + F.ceil(F.col("most") * similarity - 1e-6) - 1 >= F.col("both") * (similarity / (1 + similarity)) - 1e-6
    return found.filter(enough).select("a", "b")


def with_set_components(docs: DataFrame, similarity: float, shingle: int | None = None, sample: DataFrame | None = None, radius: int = RADIUS, hashes: int = 1) -> DataFrame:
    """node, root and component_id instead of the last column, the texts or (no `shingle`) sets; links are all pairs that similar.

    Trees of fingerprints give links first, each decided exactly; then the keys that these leave apart are gone through.

    The sets are made again when candidates are decided rather than stored. `sample` has some of the rows, or all by default.
    """
    rest = docs.columns[:-1]
    points = checkpointed(first_shingles(docs, shingle, docs if sample is None else sample, similarity, hashes))
    rows = points.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows // ROWS_PER_SHARD)))).alias("shard")

    def run(part: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("key", "node", "keys"), shared_keys(*(part.column(c).to_numpy() for c in ("key", "node"))), strict=True)))

    dealt = points.select(F.explode("prefix").alias("key"), "node").select(shard, "key", "node")
    shared = checkpointed(dealt.groupBy("shard").applyInArrow(run, "key long, node long, keys long"))
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-shared.count() // KEY_ROWS_PER_SHARD)))).alias("shard")
    held = points.groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("prints").alias("prints"))
    held = checkpointed(held.join(shared.select("node").distinct(), "node"))
    pairs = checkpointed(tree_candidates(shared.join(held, "node").select(shard, "key", "node", "size", "bits", "prints"), similarity, radius))
    links = exact_links(docs, shingle, pairs, similarity)
    star = checkpointed(components(links := checkpointed(links)))
    rooted = held.join(star, "node", "left").select("node", "size", "bits", F.coalesce("root", "node").alias("root"))
    rest_of = candidate_pairs(shared.join(rooted, "node").select(shard, "key", "node", "size", "root", "keys", "bits"), similarity)
    rest_of = checkpointed(rest_of.join(pairs, ["a", "b"], "left_anti"))
    if not rest_of.isEmpty():
        star = checkpointed(components(links.union(exact_links(docs, shingle, rest_of, similarity))))
    grouped = checkpointed(points.select(*rest, "node").join(star, "node", "left").select(*rest, "node", F.coalesce("root", "node").alias("root")))
    ids = checkpointed(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return grouped.join(ids, "root")


def exact_links(docs: DataFrame, shingle: int | None, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have that Jaccard similarity or more."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    slots = np.zeros(SLOTS, bool)
    slots[arrays(ends.select(F.pmod("node", F.lit(SLOTS)).alias("slot")).distinct())[0]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def each(columns: list, sets: pa.Array, node: list) -> pa.RecordBatch:
        at = np.array(node, np.int64) % SLOTS
        some = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), sets], ["node", "shingles"]).filter(pa.array(some))

    found = over_sets(docs.select(docs.columns[-1]), shingle, each, "node long, shingles array<long>")
    held = checkpointed(found.dropDuplicates(["node"]))
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("of"))
    return both.filter(F.col("n") / (F.col("of") - F.col("n")) >= similarity).select("a", "b")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hashes: int = 1, similarity: float | None = None) -> DataFrame:
    """One row of each component, one with the least id, with all columns of `docs`.

    Components are told apart by their roots, since ids may be repeated or null. Of rows with that id the one with the least text digest stays, and of equal rows any one. With a `similarity` trees of
    fingerprints give the links first, and the shingle sets decide, exactly.
    """
    digests = docs.withColumn("__text", F.xxhash64("text"))
    if similarity is None:
        found = with_components(checkpointed(fingerprints(digests, shingle, ("doc_id", "__text"), hashes)), radius, hashes)
    else:
        rows = digests.select("doc_id", "__text", "text")
        found = with_set_components(rows, similarity, shingle, rows.filter(F.pmod("__text", F.lit(SAMPLED)) == 0), radius, hashes)
    found = found.filter("doc_id <=> component_id")
    first = checkpointed(found.groupBy("root").agg(F.min_by(F.struct("doc_id", "__text"), "__text").alias("kept"), F.count(F.lit(1)).alias("n")))
    keys = first.select(F.col("kept.doc_id").alias("__id"), F.col("kept.__text").alias("__kept"))
    kept = docs.join(keys, docs["doc_id"].eqNullSafe(keys["__id"]) & (F.xxhash64(docs["text"]) == keys["__kept"]), "left_semi")
    if first.filter("n > 1").isEmpty():
        return kept
    return kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = checkpointed(fingerprints(table(spark, sf_dir, "documents")))
    return with_components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
