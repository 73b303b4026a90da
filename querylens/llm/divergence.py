"""Source divergence audit: how far the sources of a language lie apart, and by which terms.

Each (lang, source) group and each language gives every kept term a smoothed share in whole billionths; the divergence of a
share p from a share q is floor((p - q)^2 / q). All numbers are 64-bit integers, exact up to 9 * 10^15 occurrences.

* Counts: a task counts the terms of its texts by (lang, source) in a bounded table and gives out sums, which meet per
  (lang, source, term), so no source, language or term gathers in a task; a window over (lang, term) has a row for each
  source. A long text is counted in pieces that end between terms.
* Pairs of sources are sparse. A term that neither source has adds the same to all pairs of shares of nothing: the baseline,
  V times. What a source's own terms add to that depends on its count only, so it is summed over the distinct counts of
  each group. Only terms that both sources have are corrected one by one: a task holds the terms dealt to it, sums its
  corrections by pair in bounded blocks, and gives out one row for each pair.
* Ranks up to `k` come by radix selection. Histograms over 16 bits of the value at a time, from the highest, find the bin of
  each group's kth value; rows that tie there are refined by the bytes of the term in the same way. What is then ranked is
  at most k rows and a small last bin for each group.

Defined results: null text, lang and source are empty strings; repeated rows are documents of their own; a language without
kept terms has pairs of value 0 and no terms; a language's only source has no pairs; an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm._shared import checkpointed, small_side, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS = 3
RANKS = 200
DIGIT_BITS = 16
LAST_BIN = 1000  # rows of a group's last bin that are ranked without further digits
BLOCK_PAIRS = 1 << 20
KEYS = ["lang", "source"]
HELD_TERMS = 400_000  # entries of a task's table, over all its groups
PIECE_BYTES = 1 << 22
# bytes of a text as those of its terms, with a space for each byte between them; bytes beyond ASCII are parts of terms
_AS_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, some megabytes at a time."""
    text = text.translate(_AS_TERMS)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + PIECE_BYTES)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and docs (rows that hold the term)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts, docs_of = tables.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(counts), set()
                for terms in _pieces(text.as_py()):
                    counts.update(terms)
                    seen.update(terms)
                docs_of.update(seen)
                held += len(counts) - before
                if held > HELD_TERMS:
                    yield from _counted(tables)
                    tables, held = {}, 0
        yield from _counted(tables)

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in KEYS], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.mapInArrow(count, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _counted(tables: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs_of) in tables.items():
        n = len(counts)
        terms = pa.array(list(counts), pa.binary()).cast(pa.string())
        same = [pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int32))) for x in (lang, source)]
        numbers = [pa.array(np.fromiter(x, np.int64, n)) for x in (counts.values(), map(docs_of.__getitem__, counts))]
        yield pa.RecordBatch.from_arrays([*same, terms, *numbers], ["lang", "source", "term", "count", "docs"])


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), three decimal digits at a time so that no product leaves 64 bits."""
    out, rest = F.lit(0).cast("long"), (count + 1).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, total), rest % total
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def radix_select(rows: DataFrame, k: int) -> DataFrame:
    """The rows (lang, source, item, value >= 0) of rank 1 to k in their group, by value descending, then item ascending.

    `rows` is read once a digit, so give it checkpointed. Items are distinct in a group.
    """
    most = rows.agg(F.max("value")).first()[0] or 0
    shift = max(0, -(-int(most).bit_length() // DIGIT_BITS) - 1) * DIGIT_BITS
    # groups of more than k rows: `need` rows of the bin `prefix` are still to be chosen
    state = rows.groupBy(KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).select(*KEYS, F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    state = checkpointed(state)
    while True:
        digit = F.shiftright("value", shift)
        bins = rows.join(small_side(state), KEYS).filter(F.shiftright("value", shift + DIGIT_BITS) == F.col("prefix") if shift + DIGIT_BITS < 64 else F.lit(True))
        state = checkpointed(_bin_of_kth(bins.groupBy(*KEYS, "need", digit.alias("prefix")).agg(F.count(F.lit(1)).alias("n")), F.col("prefix").desc()))
        if shift == 0:
            break
        shift -= DIGIT_BITS
    state = state.withColumnRenamed("prefix", "least")
    placed = rows.join(small_side(state), KEYS, "left")
    chosen = placed.filter(F.col("least").isNull() | (F.col("value") > F.col("least")) | (F.col("value") == F.col("least")) & (F.col("n") <= LAST_BIN)).select(*KEYS, "item", "value")
    crowded = state.filter(F.col("n") > LAST_BIN)
    if not crowded.isEmpty():
        ties = checkpointed(rows.join(small_side(crowded), KEYS).filter(F.col("value") == F.col("least")).select(*KEYS, "item", "value"))
        chosen = chosen.unionByName(_first_items(ties, crowded.select(*KEYS, "need")))
    rank = F.row_number().over(Window.partitionBy(KEYS).orderBy(F.col("value").desc(), "item"))
    return chosen.withColumn("rank", rank).filter(F.col("rank") <= k)


def _bin_of_kth(bins: DataFrame, order: Column) -> DataFrame:
    """Of (lang, source, need, prefix, n), the bin that holds each group's need-th row, and what is needed of it."""
    so_far = F.sum("n").over(Window.partitionBy(KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return bins.withColumn("to", so_far).filter((F.col("to") >= F.col("need")) & (F.col("to") - F.col("n") < F.col("need"))).select(*KEYS, "prefix", (F.col("need") - F.col("to") + F.col("n")).alias("need"), "n")


def _first_items(ties: DataFrame, need: DataFrame) -> DataFrame:
    """A superset of the first `need` items of each group by UTF-8 bytes: those before a bin of LAST_BIN rows at most, and it."""
    coded = F.encode("item", "UTF-8")
    state, size, step, at_once = need.withColumn("prefix", F.lit(b"")), 0, 0, 2
    while True:
        bins = ties.join(small_side(state.select(*KEYS, "need", F.col("prefix").alias("known"))), KEYS).filter(F.substring(coded, 1, size) == F.col("known") if size else F.lit(True))
        size += at_once
        step += 1
        at_once = 2 if step < 4 else at_once * 2  # a long common beginning is passed in a few rounds
        state = checkpointed(_bin_of_kth(bins.groupBy(*KEYS, "need", F.substring(coded, 1, size).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), F.col("prefix")))
        # groups whose bin is small are done: their bound is the end of that bin
        done = state.filter(F.col("n") <= LAST_BIN).select(*KEYS, F.col("prefix").alias("last"))
        mine = ties.join(small_side(done), KEYS).filter(F.substring(coded, 1, size) <= F.col("last")).select(*KEYS, "item", "value")
        out = mine if step == 1 else out.unionByName(mine)
        state = state.filter(F.col("n") > LAST_BIN)
        if state.isEmpty():
            return out


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, g = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, g = a[order], b[order], g[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], np.add.reduceat(g, new) if len(new) else g


def _corrections(start: np.ndarray, size: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums by ordered pair of groups over the terms that both have; start and size of each row's run of equal terms."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
        n = size[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)
        a, b = a[a != b], b[a != b]
        yield _summed([(group[a], group[b], _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b]))])
        at = to


def shared_terms(rows: DataFrame) -> DataFrame:
    """(a, b, both): what terms of both groups a and b add to the baseline. Rows: lang, term, group, p, p0."""

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, rest = [], 0, None
        for batch in _and_last(batches):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or not len(rest):
                continue
            lang, term = (rest.column(c).combine_chunks() for c in ("lang", "term"))
            differ = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)))
            new = np.flatnonzero(np.r_[True, differ.to_numpy(zero_copy_only=False)])
            end = len(rest) if batch is None else int(new[-1])  # the last run may go on in the next batch
            new = new[new < end]
            if end:
                sizes = np.diff(np.r_[new, end])
                group, p, p0 = (rest.column(c).to_numpy()[:end] for c in ("group", "p", "p0"))
                for part in _corrections(np.repeat(new, sizes), np.repeat(sizes, sizes), group, p, p0):
                    parts.append(part)
                    held += len(part[0])
                    if held > BLOCK_PAIRS:
                        parts = [_summed(parts)]
                        held = len(parts[0][0])
                        if held > BLOCK_PAIRS // 2:
                            yield _pairs(parts[0])
                            parts, held = [], 0
                rest = rest.slice(end)
        if parts:
            yield _pairs(_summed(parts))

    dealt = rows.select("lang", "term", "group", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(correct, "a long, b long, both long").groupBy("a", "b").agg(F.sum("both").alias("both"))


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _pairs(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], ["a", "b", "both"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    spread = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(spread), "lang_count": F.sum("count").over(spread), "first": (F.row_number().over(spread.orderBy("source")) == 1).cast("long")})
    kept = checkpointed(kept.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "count", "lang_count", "first"))

    everywhere = Window.partitionBy("lang")
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in KEYS]).distinct()
    groups = groups.join(kept.groupBy(KEYS).agg(F.sum("count").alias("n"), F.sum("first").alias("terms")), KEYS, "left").fillna(0, ["n", "terms"])
    groups = groups.withColumns({"vocabulary": F.sum("terms").over(everywhere), "lang_n": F.sum("n").over(everywhere)})
    total = F.nullif(F.col("n") + F.col("vocabulary"), F.lit(0))
    groups = checkpointed(groups.select(*KEYS, "n", "vocabulary", "lang_n", share(F.lit(0), total).alias("p0"), F.monotonically_increasing_id().alias("group")))

    shares = kept.join(small_side(groups), KEYS).select(*KEYS, "term", "group", "p0", share(F.col("count"), F.col("n") + F.col("vocabulary")).alias("p"), share(F.col("lang_count"), F.col("lang_n") + F.col("vocabulary")).alias("q"))
    terms = shares.filter(F.col("p") > F.col("q")).select(*KEYS, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = radix_select(checkpointed(terms), ranks).select(*KEYS, F.lit("term").alias("part"), "item", "value", "rank")
    return _pair_part(shares, groups).unionByName(terms)


def _pair_part(shares: DataFrame, groups: DataFrame) -> DataFrame:
    by_share = shares.groupBy("lang", "group", "p0", "p").agg(F.count(F.lit(1)).alias("terms"))
    other = groups.select("lang", F.col("group").alias("other"), F.col("p0").alias("other_p0"))
    met = by_share.join(small_side(other), "lang").filter(F.col("group") != F.col("other"))
    to, back = (F.col("terms") * (divergence(*x) - divergence(*y)) for x, y in (((F.col("p"), F.col("other_p0")), (F.col("p0"), F.col("other_p0"))), ((F.col("other_p0"), F.col("p")), (F.col("other_p0"), F.col("p0")))))
    own = checkpointed(met.groupBy("group", "other").agg(F.sum(to).alias("to"), F.sum(back).alias("back")))
    a = groups.select(*KEYS, "vocabulary", F.col("p0").alias("pa"), F.col("group").alias("a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("pb"), F.col("group").alias("b"))
    pairs = a.join(small_side(b), "lang").filter(F.col("a") != F.col("b"))
    pairs = pairs.join(own.select(F.col("group").alias("a"), F.col("other").alias("b"), "to"), ["a", "b"], "left")
    pairs = pairs.join(own.select(F.col("other").alias("a"), F.col("group").alias("b"), "back"), ["a", "b"], "left")
    pairs = pairs.join(shared_terms(shares), ["a", "b"], "left")
    value = F.coalesce(F.col("vocabulary") * divergence(F.col("pa"), F.col("pb")), F.lit(0)) + sum(F.coalesce(c, F.lit(0)) for c in ("to", "back", "both"))
    rank = F.row_number().over(Window.partitionBy(KEYS).orderBy(F.col("value").desc(), "item"))
    return pairs.select(*KEYS, F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", rank)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents
), tokens AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_count FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, k.lang_count, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total, count(*) AS v FROM dense GROUP BY lang, source),
langs AS (SELECT lang, sum(lang_count)::HUGEINT AS lang_total FROM kept GROUP BY lang),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p, 1 + (1000000000::HUGEINT * (lang_count + 1)) // (lang_total + v) AS q
  FROM dense JOIN totals USING (lang, source) JOIN langs USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
