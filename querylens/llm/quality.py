"""Quality rules: statistics of simple rules, and an isolation forest over them.

A document that breaks a base rule (too few words, or mostly repeated word triples) is rejected. The others are judged by an
isolation forest: trees split at random features and values; a row that random splits separate early, on short paths, is
anomalous. The anomaly score is 2 ** (-mean path / expected path). The threshold comes from labelled rows: by a histogram
of their scores, the score that best separates good from bad while letting at least KEEP of the good pass.

Labelled ids are split by a digest (SPLIT): the forest is fitted on one part, the threshold calibrated on another, and
`report` measures on the third, which neither has seen.

Junk may be so common that it is no anomaly among all rows (a tenth of them, all alike). So the forest is fitted on rows
labelled good, and splits reach a margin beyond the values a node holds, which makes what lies outside end on short paths.
It takes a sample of TREES x ROWS_PER_TREE such rows at most, those with the least digests of their ids over the whole
table: subsampling is part of the method. Statistics and the calibration cover all rows.

Defined results: a null or empty text has no words and fails; words and lines of any length are read whole; repeated rows
get the same verdict; without labelled rows of both kinds the forest rejects nothing (duplicate labels of an id: the worst counts); an empty table gives an empty result.
Extra columns are kept by `judge`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import arrays, checkpointed, table

TREES = 100
ROWS_PER_TREE = 256
KEEP = 0.995
SPLIT = {"fit": (0, 40), "calibrate": (40, 80), "report": (80, 100)}  # percent of the labelled ids
MARGIN = 0.05
BINS = 4096
SEED = 7
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
PUNCTUATION = b"!\"'(),-./:;?@[\\]^_`{}~"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_capitals")


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics STATS of one text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode()
    words = raw.split()  # bytes split at just the ASCII white space that counts here
    seen: set[str] = set()
    dup_lines = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup_lines += 1
            elif line.strip(SPACES):
                seen.add(line)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - count(SPACES.encode()), count(SYMBOLS.encode()), dup_lines, repeat_words(words), count(PUNCTUATION), count(CAPITALS)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a triple of neighbours which the list has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # else three numbers fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, by one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(x.as_py()) for x in batch.column(1)]
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(STATS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def features(s: np.ndarray) -> np.ndarray:
    """Rates that don't depend on the length of the text; s has the columns STATS."""
    words = np.maximum(s[:, 0], 1).astype(float)
    chars = np.maximum(s[:, 1], 1).astype(float)
    return np.column_stack([np.log(chars / words), *(np.sqrt(s[:, k] / n) for k, n in ((2, chars), (3, words), (4, words), (5, chars), (6, chars)))])


class IsolationForest:
    """Random trees as flat arrays; children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS_PER_TREE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.rows)))))
        size = 2 ** (self.depth + 1) - 1
        margin = MARGIN * (x.max(0) - x.min(0)) + MARGIN
        self.feature = np.full((trees, size), -1, np.int16)
        self.value = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        for t in range(trees):
            part = x[rng.permutation(len(x))[: self.rows]]
            todo = [(0, 0, part)]
            while todo:
                node, depth, held = todo.pop()
                self.path[t, node] = depth + expected_path(len(held))
                if depth < self.depth and len(held) > 1:
                    f = int(rng.integers(x.shape[1]))
                    v = rng.uniform(held[:, f].min() - margin[f], held[:, f].max() + margin[f])
                    self.feature[t, node], self.value[t, node] = f, v
                    left = held[:, f] <= v
                    todo += [(2 * node + 1, depth + 1, held[left]), (2 * node + 2, depth + 1, held[~left])]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1); higher is more anomalous."""
        total = np.zeros(len(x))
        at = np.arange(len(x))
        for feature, value, path in zip(self.feature, self.value, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 2 - (x[at, f] <= value[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(expected_path(self.rows), 1e-9))


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def calibrate(good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> float:
    """The bin edge with the best true minus false rejections that keeps `keep` of the good. good and bad count rows by bin."""
    if not good.sum() or not bad.sum():
        return float("inf")
    kept = np.cumsum(good) / good.sum()  # rejected: bins above k
    gain = (1 - np.cumsum(bad) / bad.sum()) - (1 - kept)
    gain[kept < keep] = -1
    return (int(np.argmax(gain)) + 1) / len(good) if gain.max() > 0 else float("inf")


class QualityModel:
    """A fitted forest (None: nothing to fit on) and its threshold."""

    def __init__(self, forest: IsolationForest | None, threshold: float = float("inf")):
        self.forest, self.threshold = forest, threshold

    def judge(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anomaly, base_failed and kept for rows of STATS."""
        anomaly = self.forest.score(features(s)) if self.forest and len(s) else np.zeros(len(s))
        failed = (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])
        return anomaly, failed, ~failed & (anomaly < self.threshold)


def judge_stats(stats: DataFrame, model: QualityModel, *carried: str) -> DataFrame:
    """doc_id, the statistics, the carried columns, anomaly, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.column_stack([batch.column(c).to_numpy() for c in STATS])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, model.judge(s))], [*batch.schema.names, "anomaly", "base_failed", "kept"])

    rows = stats.select("doc_id", *STATS, *carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", anomaly double, base_failed boolean, kept boolean")


def labelled(stats: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """The rows of one part of the split that pass the base rules, with their quality."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    low, high = SPLIT[part]
    percent = F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(100))
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return stats.filter(~failed & (percent >= low) & (percent < high)).join(known, "doc_id")


def report(stats: DataFrame, labels: DataFrame, model: QualityModel) -> DataFrame:
    """quality, n and n_kept over the labelled rows that neither the forest nor the threshold has seen."""
    return judge_stats(labelled(stats, labels, "report"), model, "quality").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("n_kept"))


def fit(stats: DataFrame, labels: DataFrame, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, keep: float = KEEP) -> QualityModel:
    """Fit on a table of statistics, which should be given checkpointed. `labels` has doc_id and quality (1 good, 0 bad, null not known)."""
    good = labelled(stats, labels, "fit").filter("quality = 1").withColumn("draw", F.xxhash64("doc_id", F.lit(SEED)))
    # of very many good rows, those with a small draw hold the sample; so tasks don't send the driver a full sample each
    share = min(1.0, 2 * trees * rows_per_tree / max(1, good.count()))
    near = good.filter(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = near.orderBy(F.pmod("draw", F.lit(1 << 30)), "draw", *STATS).limit(trees * rows_per_tree).select(*STATS)
    sample = np.column_stack(arrays(sample))
    if len(sample) < 2:
        return QualityModel(None)
    model = QualityModel(IsolationForest(features(sample), trees, rows_per_tree))
    bins = F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")
    counts = judge_stats(labelled(stats, labels, "calibrate"), model, "quality").groupBy("quality", bins).count().collect()  # 2 x BINS rows at most
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in counts:
        (good if r["quality"] else bad)[r["bin"]] += r["count"]
    model.threshold = calibrate(good, bad, keep)
    return model


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns. Texts are read twice rather than shuffled."""
    model = fit(checkpointed(with_stats(docs)), labels, **how)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([text_stats(x.as_py()) for x in batch.column(text)], np.int64).reshape(-1, len(STATS))
            yield batch.filter(pa.array(model.judge(s)[2]))

    return docs.mapInArrow(run, docs.schema)


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpointed(with_stats(table(spark, sf_dir, "documents")))
    judged = judge_stats(stats, fit(stats, table(spark, sf_dir, "labels")))
    return judged.select(*CONTRACT, *[c for c in judged.columns if c not in CONTRACT])
