"""Language-model scoring with a probabilistic suffix tree.

Texts are sequences of tokens: lower-cased words and one end. The tree models their spelling in bytes, a space after each word
and an end byte after the last. Its nodes are contexts of up to DEPTH bytes. A context is a candidate if its share of all positions is at least
LEAST_SHARE, which bounds the model by DEPTH / LEAST_SHARE contexts whatever the corpus holds, and it is retained if its
next-byte distribution diverges from that of its suffix: count times Kullback-Leibler divergence of at least DIVERGENCE nats
(suffixes of retained contexts are retained too). A distribution is smoothed with its suffix's in proportion to its number of
different next bytes; the root's with one count for each byte. A text is scored by the longest retained suffix before each
byte, followed as an automaton with one table look-up a byte, for many blocks of text in step.

Above the tree stands a node over whole tokens, which grows with the corpus: it holds every training token with its count c,
however rare, and is smoothed with the spelling's probability p: WORD_SHARE c / N + (1 - WORD_SHARE) p. Its table stays
distributed, but for the most frequent words.

All counts cover all training rows: tasks emit sums by 64-bit key (a gram's bytes, or a word's XXH64), which Spark adds up.
Beside the tree the operator gives each text's add-one unigram score over words. The MOST_WORDS most frequent words are
broadcast (16 bytes each); a text's other words are joined to the counts by key, so every word counts exactly. Two words
share a 64-bit key with odds of the square of their number over 2^65.

Defined results: a null or empty text is the end token alone; rows with a null id hash like the empty string; repeated rows
are scored each on their own; with nothing to learn from every score is that of uniform bytes; an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import arrays, checkpointed, table

DEPTH = 5
LEAST_SHARE = 1e-5
DIVERGENCE = 3.0
MOST_WORDS = 1_000_000
WORD_SHARE = 0.15  # of a token's probability that comes from counts of whole tokens
FLUSH = 300_000
BLOCK = 512
BATCH_BYTES = 2_000_000
END = 10  # a byte that is in no word; stands for the end of a text and for what is before its start
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END_KEY = xxhash.xxh64_intdigest(b"\n") - (1 << 63)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes split at just the ASCII white space that counts here."""
    return (text or "").encode().translate(_UPPER).split()


def spelled(words: list[bytes]) -> bytes:
    return b" ".join([*words, b"\n"])


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of each of n owners' values, as doubles also where there are none (bincount gives whole numbers then)."""
    return np.bincount(owner, values, n).astype(np.float64)


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each text: the `depth` bytes before it and itself, as one number."""
    lead = bytes([END]) * depth
    data = np.frombuffer(lead + lead.join(texts), np.uint8)
    key = np.zeros(len(data) - depth, np.uint64)
    for k in range(depth + 1):
        key = key << np.uint64(8) | data[k : len(data) - depth + k]
    ends = np.cumsum([len(t) + depth for t in texts]) - depth
    inside = np.ones(len(key), bool)
    for k in range(depth):  # positions of the next text's lead
        at = ends[:-1] + k
        inside[at] = False
    return key[inside]


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(is_word, key, n) over all rows of `docs`: the words with the end, and the grams."""

    def batch_of(is_word: bool, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), is_word)), pa.array(key), pa.array(n)], ["is_word", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def merged() -> list[tuple[np.ndarray, np.ndarray]]:
            if not held:
                return []
            key, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            key, back = np.unique(key, return_inverse=True)
            return [(key, np.bincount(back, n).astype(np.int64))]

        def words_out() -> pa.RecordBatch:
            out = batch_of(True, np.fromiter(map(word_key, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()
            return out

        for batch in batches:
            texts, size = [], 0
            for x in [*batch.column(0), None]:
                if x is not None:
                    words = words_of(x.as_py())
                    rows += 1
                    for w in words:
                        seen[w] = seen.get(w, 0) + 1
                    texts.append(spelled(words))
                    size += len(texts[-1])
                if texts and (x is None or size > BATCH_BYTES):
                    held.append(np.unique(grams(texts, depth), return_counts=True))
                    texts, size = [], 0
                if len(seen) > FLUSH:
                    yield words_out()
                if sum(len(h[0]) for h in held) > 8 * FLUSH:
                    held[:] = merged()
                    if len(held[0][0]) > 4 * FLUSH:
                        yield batch_of(False, held[0][0].astype(np.int64), held[0][1])
                        held.clear()
        for key, n in merged():
            yield batch_of(False, key.astype(np.int64), n)
        if rows:
            yield words_out()
            yield batch_of(True, np.array([_END_KEY]), np.array([rows], np.int64))

    return docs.select("text").mapInArrow(run, "is_word boolean, key long, n long").groupBy("is_word", "key").agg(F.sum("n").alias("n"))


class SuffixTree:
    """Automaton over the retained contexts and what closes them under prefixes and suffixes.

    levels[d] are (key, n) of all grams of d + 1 bytes whose d-byte context is a candidate.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], divergence: float = DIVERGENCE):
        key0, n0 = levels[0] if levels else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.codes = np.full(256, len(key0), np.uint8 if len(key0) < 255 else np.uint16)
        self.codes[key0] = np.arange(len(key0))
        self.width = width = len(key0) + 1
        self.depth = len(levels) - 1
        root = np.full(width, 1.0)
        root[:-1] += n0
        root /= n0.sum() + 256
        # divergence from the suffix's distribution, row by row; longest first, so that suffixes of retained contexts are retained
        firsts, totals = [], []
        for key, n in levels:
            first = np.flatnonzero(np.concatenate([[True], key[1:] >> 8 != key[:-1] >> 8])) if len(key) else np.zeros(0, np.int64)
            sums = np.add.reduceat(n, first) if len(key) else n
            firsts.append(first)
            totals.append(np.repeat(sums, np.diff(np.append(first, len(key)))))
        wanted: list[np.ndarray] = [np.zeros(0, np.int64)] * (self.depth + 1)
        for d in range(self.depth, 0, -1):
            (key, n), (above, above_n) = levels[d], levels[d - 1]
            if len(key):
                at = np.searchsorted(above, key & ((1 << 8 * d) - 1))
                part = n * (np.log(n / totals[d]) - np.log(above_n[at] / totals[d - 1][at]))
                gain = np.add.reduceat(part, firsts[d])
                wanted[d] = np.union1d(wanted[d], (key[firsts[d]] >> 8)[gain >= divergence])
            if d > 1:
                wanted[d - 1] = np.unique(wanted[d] & ((1 << 8 * (d - 1)) - 1))
        # distributions of retained contexts, by level; a context's suffix is its key without the top byte
        kept, chance = [np.zeros(1, np.int64)], [root.reshape(1, -1)]
        for d in range(1, self.depth + 1):
            context = wanted[d]
            rows = np.isin(levels[d][0] >> 8, context)
            key, n = levels[d][0][rows], levels[d][1][rows]
            counted = np.zeros((len(context), width))
            counted[np.searchsorted(context, key >> 8), self.codes[key & 255]] = n
            kinds = (counted > 0).sum(1, keepdims=True)
            parent = chance[d - 1][np.searchsorted(kept[d - 1], context & ((1 << 8 * (d - 1)) - 1))]
            kept.append(context)
            chance.append((counted + kinds * parent) / (counted.sum(1, keepdims=True) + kinds))
        self.n_contexts = sum(map(len, kept))
        self._automaton(kept, chance)

    def _automaton(self, kept: list[np.ndarray], chance: list[np.ndarray]) -> None:
        states = [set(k.tolist()) for k in kept]
        for d in range(self.depth, 0, -1):
            for k in list(states[d]):
                states[d - 1].add(k >> 8)
                states[d - 1].add(k & ((1 << 8 * (d - 1)) - 1))
        levels = [np.array(sorted(s), np.int64) for s in states]
        first = np.cumsum([0, *map(len, levels)])
        go = np.zeros((int(first[-1]), self.width), np.int32)
        logs = np.zeros((int(first[-1]), self.width), np.float32)
        logs[0] = np.log10(chance[0][0])
        for d in range(self.depth + 1):
            if d:
                up = first[d - 1] + np.searchsorted(levels[d - 1], levels[d] & ((1 << 8 * (d - 1)) - 1))
                go[first[d] : first[d + 1]] = go[up]
                logs[first[d] : first[d + 1]] = logs[up]
                logs[first[d] + np.searchsorted(levels[d], kept[d])] = np.log10(chance[d])
            if d < self.depth and len(levels[d + 1]):
                start = first[d] + np.searchsorted(levels[d], levels[d + 1] >> 8)
                go[start, self.codes[levels[d + 1] & 255]] = first[d + 1] + np.arange(len(levels[d + 1]))
        self.go = (go * self.width).ravel()
        self.logs = logs.ravel()

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each byte of the texts, given with their end bytes, text after text."""
        lead = self.depth
        n_blocks = np.array([-(-len(t) // BLOCK) for t in texts], np.int64)
        rows = np.full((int(n_blocks.sum()), BLOCK + lead), END, np.uint8)
        sizes = np.zeros(len(rows), np.int64)
        at = 0
        for t in texts:
            padded = np.frombuffer(bytes([END]) * lead + t, np.uint8)
            for s in range(0, len(t), BLOCK):
                part = padded[s : s + BLOCK + lead]
                rows[at, : len(part)] = part
                sizes[at] = len(part) - lead
                at += 1
        # longest blocks first: those that go on are a prefix
        order = np.argsort(-sizes, kind="stable")
        place = (np.cumsum(sizes) - sizes)[order]
        out = np.empty(int(sizes.sum()), np.float32)
        sizes = sizes[order]
        steps = np.ascontiguousarray(self.codes[rows[order]].T)
        state = np.zeros(len(rows), np.int32)
        going = np.searchsorted(-sizes, -np.arange(1, BLOCK + 1), "right")
        for k, codes in enumerate(steps):
            if k >= lead:
                n = int(going[k - lead])
                if not n:
                    break
                state, codes = state[:n], codes[:n]
            step = state + codes
            if k >= lead:
                out[place[: len(step)] + k - lead] = self.logs[step]
            state = self.go[step]
        return out


def fit_tree(summed: DataFrame, depth: int = DEPTH, least_share: float = LEAST_SHARE, divergence: float = DIVERGENCE) -> SuffixTree:
    """Fit on the checkpointed result of `counts`."""
    held = summed.filter("NOT is_word").select("key", "n")
    total = held.agg(F.sum("n")).first()[0] or 0
    levels = []
    for d in range(depth, -1, -1):
        if d < depth:
            held = checkpointed(held.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")))
        context = F.shiftright("key", 8)
        often = held.groupBy(context.alias("context")).agg(F.sum("n").alias("m")).filter(F.col("m") >= max(1.0, least_share * total)).select("context")
        key, n = arrays((held.join(often, context == F.col("context")) if d else held).select("key", "n"))
        order = np.argsort(key)
        levels.append((key[order], n[order]))
    return SuffixTree(levels[::-1], divergence)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, training: DataFrame, depth: int = DEPTH, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of `docs`."""
    spark = docs.sparkSession
    summed = checkpointed(counts(training, depth))
    tree = fit_tree(summed, depth)
    words = summed.filter("is_word").select("key", "n")
    all_tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # a count above which at most `most_words` words are: found by halving over a histogram of counts, not by sorting words
    sizes = words.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).orderBy(F.desc("size")).collect()
    least, taken = 1 << 62, 0
    for r in sizes:
        taken += r["m"]
        if taken > most_words:
            break
        least = r["least"]
    top, times = arrays(words.filter(F.col("n") >= least))
    order = np.argsort(top)
    shared = spark.sparkContext.broadcast((top[order], times[order].astype(np.float64), tree))
    share, tokens = (WORD_SHARE, float(all_tokens)) if all_tokens else (0.0, 1.0)
    unknown = float(np.log10(1 - share))
    denominator = float(np.log10(all_tokens + kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counted, model = shared.value
        logs = np.log10(counted + 1.0)
        known: dict[bytes, int] = {}

        def scored(ids: list, all_words: list[list[bytes]]) -> pa.RecordBatch:
            if len(known) > FLUSH:
                known.clear()
            sizes = np.array([len(w) + 1 for w in all_words], np.int64)
            flat = [w for words in all_words for w in (*words, b"\n")]
            fresh = list({w for w in flat if w not in known})
            if fresh:
                k = np.fromiter(map(word_key, fresh), np.int64, len(fresh))
                at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
                there = keys[at] == k if len(keys) else np.zeros(len(k), bool)
                known.update(zip(fresh, np.where(there, at, -1).tolist(), strict=True))
            place = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            owner = np.repeat(np.arange(len(ids)), sizes)
            top_known = np.bincount(owner[place >= 0], minlength=len(ids))
            base = sums(owner[place >= 0], logs[place[place >= 0]], len(ids))
            rare = np.flatnonzero(place < 0)
            rare_keys = np.fromiter((word_key(flat[i]) for i in rare.tolist()), np.int64, len(rare))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(ids)))]).astype(np.int32)
            widths = np.fromiter((len(w) + (w != b"\n") for w in flat), np.int64, len(flat))  # a word's space is its own
            spelling = model.score([spelled(w) for w in all_words]).astype(np.float64)
            spelling = np.add.reduceat(spelling, np.cumsum(widths) - widths) if len(flat) else spelling
            token, seen = spelling + unknown, place >= 0
            token[seen] = np.log10(share * counted[place[seen]] / tokens + (1 - share) * 10 ** spelling[seen])
            score = sums(owner, token, len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rare_keys), pa.array(spelling[rare])], ["key", "spelling"]))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(top_known.astype(np.int64)), pa.array(base), pa.array(score), lists],
                ["doc_id", "n_tokens", "top_known", "top_logs", "score", "rare"],
            )

        for batch in batches:
            ids, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id.as_py())
                held.append(words_of(text))
                size += len(text or "")
                if size > BATCH_BYTES:
                    yield scored(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield scored(ids, held)

    schema = "doc_id long, n_tokens long, top_known long, top_logs double, score double, rare array<struct<key: long, spelling: double>>"
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    rare = rows.select("row", F.explode("rare").alias("rare")).select("row", "rare.key", "rare.spelling").join(words, "key")
    # in place of the score as an unknown word that the row has so far
    more = F.log10(F.col("n") * (share / tokens) + (1 - share) * F.pow(F.lit(10.0), "spelling")) - F.col("spelling") - unknown
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.sum(more).alias("more"))
    return rows.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("top_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(all_tokens)).cast("long").alias("train_tokens"),
        (F.col("top_logs") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, docs.filter(~held_out())).withColumn("held_out", held_out())
