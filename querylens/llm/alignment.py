"""Alignment of two tokenizers' tokens: a byte-level BPE (A) and a sentence-piece BPE with byte fallback (B).

Where a token of A and one of B end at the same byte, both sequences are cut; what lies between two cuts is a group, and every
token of A is linked with every token of B in its group. How many documents hold a pair of ids linked is counted over the
corpus, and each document is scored by the counts of its links.

Python only tokenises. Documents are gathered into blocks of BLOCK_BYTES, and a block is one row: a dictionary of the
different units of its texts, as ids and end offsets of both tokenizers, and each document as a sequence of units. A unit is a
stretch between single spaces; no token of either tokenizer reaches over its ends, which the piece table is tested for when
it is loaded (else a whole text is one unit). So a word that a block holds a thousand times is aligned once.

From there on all is Spark: array_intersect of a unit's end arrays gives its cuts, zip_with, transform and sequence its groups
and links, aggregate the sums of each document, which become rows again. They are written to the shared folder and read
twice: distinct links are counted with partial sums, then all links meet their counts. The most frequent pairs, a bounded
number that is found from a histogram of counts, are broadcast, so a frequent pair is never dealt to one task and a document's
links are summed where they are; only rarer pairs are joined by key.

Defined results: texts that are null or empty, or that a tokenizer doesn't give back byte for byte (such as texts with
U+2581), have no tokens: zeros, and '' as digest. Repeated rows are documents of their own. Special tokens' strings are plain
text. An empty table gives an empty result. Extra columns are not read. A text longer than a block is a block by itself.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._shared import checkpoint_folder, checkpointed, let, table
from querylens.llm.packing import default_vocabulary, encoder

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
BLOCK_BYTES = 1 << 21
BROADCAST_PAIRS = 1_000_000
PAIR = 1 << 20  # a pair of ids is one number: A's id times this plus B's
UNITS_AT_ONCE = 8192
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WIDE_SPACE = re.compile(r"\s\s|^\s|\s\Z")
BLOCKS = "docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,units:array<int>>>, units array<struct<a_ids:array<int>,a_ends:array<int>,b_ids:array<int>,b_ends:array<int>>>"
SEARCHED = 64  # tokens of a unit up to which the place of a cut is searched for, not merged
_pieces: dict = {}


def wide(text: str) -> bool:
    """Whether white space stands at an end or beside other white space; else every space is a single one."""
    if len(text.split()) == text.count(" ") + text.count("\n") + 1:
        return False
    return _WIDE_SPACE.search(text) is not None


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_table(path: str) -> tuple:
    """The processor, the bytes of each piece, and whether texts can be cut at single spaces; one for each Python worker."""
    if path not in _pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        data = [bytes([int(s[3:5], 16)]) if sp.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        cuttable = b"\x08identity" in sp.serialized_model_proto() and not any("▁" in s.lstrip("▁") for s in names)
        _pieces[path] = sp, data, cuttable
    return _pieces[path]


def blocks(docs: DataFrame, vocabulary: str, pieces: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokenise: a row for each block of documents."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, piece_bytes, cuttable = piece_table(pieces)
        encode = encoder(vocabulary)
        a_bytes = np.array([len(encode.decode_single_token_bytes(i)) for i in range(encode.n_vocab)])
        b_bytes = np.array([len(x) for x in piece_bytes])

        def tokens(text: str) -> tuple[list, list] | None:
            """Ids of both for a space and the text; None where B doesn't give it back."""
            b = sp.encode(text)
            return (encode.encode_ordinary(" " + text), b) if b"".join(map(piece_bytes.__getitem__, b)) == f" {text}".encode() else None

        def stretches(units: list[str], spaced: set[str]) -> Iterator[tuple[list[int], tuple | None]]:
            """Numbers of units whose tokens come together, with these; units with white space at an end come alone."""
            alone = [k for k, u in enumerate(units) if u in spaced] if cuttable else range(len(units))
            joint = np.setdiff1d(np.arange(len(units)), np.array(alone, np.int64)).tolist()
            for k in alone:
                yield [k], tokens(units[k])
            for at in range(0, len(joint), UNITS_AT_ONCE):
                part = joint[at : at + UNITS_AT_ONCE]
                yield part, tokens(" ".join([units[k] for k in part]))

        def block(ids: list, texts: list[list[str]], spaced: set[str]) -> pa.RecordBatch:
            known: dict[str, int] = defaultdict(count().__next__)
            rows = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int32)
            offsets = np.cumsum([0, *map(len, texts)], dtype=np.int32)
            units = list(known)
            place, a, b, sizes = np.full(len(units), -1, np.int32), [], [], []
            for joint, found in stretches(units, spaced):
                parts = [(joint, found)] if found else [([k], tokens(units[k])) for k in joint] if len(joint) > 1 else []
                for own, both in parts:
                    if both:
                        place[own] = np.arange(len(sizes), len(sizes) + len(own))
                        sizes += [len(x) + 1 for x in " ".join([units[k] for k in own]).encode().split(b" ")] if len(own) > 1 else [len(units[own[0]].encode()) + 1]
                        a.append(both[0])
                        b.append(both[1])
            rows = place[rows]
            if (rows < 0).any():  # a text with a unit that tokens don't give back has no tokens at all
                lengths = np.diff(offsets)
                lost = np.repeat(np.bincount(np.repeat(np.arange(len(texts)), lengths), rows < 0, len(texts)) > 0, lengths)
                offsets = np.cumsum([0, *np.bincount(np.repeat(np.arange(len(texts)), lengths)[~lost], minlength=len(texts))], dtype=np.int32)
                rows = rows[~lost]
            a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int32) for x in (a, b))
            ends = np.cumsum(sizes, dtype=np.int32)
            totals, sides = [], []  # tokens of each document, from those of its units; each unit's tokens and where they end
            for found, n_bytes in ((a_ids, a_bytes), (b_ids, b_bytes)):
                found_ends = np.cumsum(n_bytes[found], dtype=np.int32)
                cuts = pa.array(np.searchsorted(found_ends, np.concatenate([[0], ends]), "right").astype(np.int32))
                totals.append(np.diff(np.concatenate([[0], np.cumsum(np.diff(cuts.to_numpy())[rows], dtype=np.int64)])[offsets]))
                sides += [pa.ListArray.from_arrays(cuts, pa.array(found)), pa.ListArray.from_arrays(cuts, pa.array(found_ends))]
            held = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, totals), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows))], ["doc_id", "n_a", "n_b", "units"])
            aligned_later = pa.StructArray.from_arrays(sides, ["a_ids", "a_ends", "b_ids", "b_ends"])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([one(held), one(aligned_later)], ["docs", "units"])

        ids, texts, spaced, size = [], [], set(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                if not text:
                    texts.append([])
                elif cuttable and not wide(text):
                    texts.append(text.split(" "))
                else:
                    units = _SINGLE_SPACE.split(text) if cuttable else [text]
                    texts.append(units)
                    spaced.update(u for u in units if u[0].isspace() or u[-1].isspace() or " " in u)
                size += len(text or "") + 64
                if size > block_bytes:
                    yield block(ids, texts, spaced)
                    ids, texts, spaced, size = [], [], set(), 0
        if ids:
            yield block(ids, texts, spaced)

    return docs.select("doc_id", "text").mapInArrow(tokenise, BLOCKS)


def positions(part: Column, whole: Column) -> Column:
    """Where each entry of `part` stands in `whole`; both ascending, every entry of the first in the second.

    Merged and sorted, an entry of `part` stands before its equal, after as many of `part` as came before it.
    """

    def twice(merged: Column) -> Column:
        places = F.transform(merged, lambda x, i: iff(x == F.get(merged, i + 1), i, F.lit(None)))
        return F.transform(F.array_except(places, F.array(F.lit(None).cast("int"))), lambda i, k: i - k)

    return let(F.sort_array(F.concat(whole, part)), twice)


def iff(condition: Column, yes: Column, no: Column) -> Column:
    return F.call_function("if", condition, yes, no)


def aligned_unit(unit: Column) -> Column:
    """n_groups, the groups' ids as text, and the links of one unit."""
    pair = lambda i, j: i.cast("long") * PAIR + j
    text = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    unit_of = lambda n, written, pairs: F.struct(n.alias("n_groups"), written.alias("written"), pairs.alias("pairs"))
    a_ids, b_ids, a_ends, b_ends = (unit[c] for c in ("a_ids", "b_ids", "a_ends", "b_ends"))

    def of_groups(cuts: Column) -> Column:
        search = lambda ends: F.transform(cuts, lambda c: (F.array_position(ends, c) - 1).cast("int"))
        searched = F.struct(search(a_ends).alias("a"), search(b_ends).alias("b"))
        merged = F.struct(positions(cuts, a_ends).alias("a"), positions(cuts, b_ends).alias("b"))
        short = F.size(a_ends) + F.size(b_ends) <= SEARCHED

        def made(x: Column) -> Column:
            i, j = F.get(a_ids, x["a_first"]), F.get(b_ids, x["b_first"])
            one = F.struct(F.concat(i.cast("string"), F.lit("|"), j.cast("string")).alias("written"), F.array(pair(i, j)).alias("pairs"))
            a, b = F.slice(a_ids, x["a_first"] + 1, x["a_last"] - x["a_first"] + 1), F.slice(b_ids, x["b_first"] + 1, x["b_last"] - x["b_first"] + 1)
            many = let(b, lambda right: F.flatten(F.transform(a, lambda p: F.transform(right, lambda q: pair(p, q)))))
            return iff((x["a_first"] == x["a_last"]) & (x["b_first"] == x["b_last"]), one, F.struct(F.concat(text(a), F.lit("|"), text(b)).alias("written"), many.alias("pairs")))

        def group(last: Column, k: Column) -> Column:
            first = lambda ends: iff(k == 0, F.lit(0), F.get(ends, k - 1) + 1)
            return let(F.struct(first(last["a"]).alias("a_first"), F.get(last["a"], k).alias("a_last"), first(last["b"]).alias("b_first"), F.get(last["b"], k).alias("b_last")), made)

        def said(groups: Column) -> Column:
            return unit_of(F.size(cuts), F.array_join(groups["written"], ";"), F.flatten(groups["pairs"]))

        return let(iff(short, searched, merged), lambda last: let(F.transform(F.sequence(F.lit(0), F.size(cuts) - 1), lambda k: group(last, k)), said))

    def of_cuts(cuts: Column) -> Column:
        single = (F.size(cuts) == F.size(a_ends)) & (F.size(cuts) == F.size(b_ends))  # a token of each in every group
        written = F.zip_with(a_ids, b_ids, lambda i, j: F.concat(i.cast("string"), F.lit("|"), j.cast("string")))
        whole = unit_of(F.lit(1), F.concat(text(a_ids), F.lit("|"), text(b_ids)), F.flatten(F.transform(a_ids, lambda i: F.transform(b_ids, lambda j: pair(i, j)))))
        return iff(single, unit_of(F.size(cuts), F.array_join(written, ";"), F.zip_with(a_ids, b_ids, pair)), iff(F.size(cuts) == 1, whole, of_groups(cuts)))

    return let(F.array_intersect(a_ends, b_ends), of_cuts)


def aligned(tokenised: DataFrame) -> DataFrame:
    """A row for each document: doc_id, its numbers and digest, and its links as pair numbers."""

    def of_docs(units: Column) -> Column:
        def doc(d: Column) -> Column:
            of = lambda u: F.get(units, u)
            n_groups = F.aggregate(d["units"], F.lit(0).cast("long"), lambda acc, u: acc + of(u)["n_groups"])
            digest = F.sha2(F.array_join(F.transform(d["units"], lambda u: of(u)["written"]), ";").cast("binary"), 256)
            links = F.flatten(F.transform(d["units"], lambda u: of(u)["pairs"]))
            return F.struct(d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), n_groups.alias("n_groups"), F.when(F.size(d["units"]) > 0, digest).otherwise("").alias("groups_sha256"), links.alias("links"))

        return F.transform("docs", doc)

    return tokenised.select(F.inline(let(F.transform("units", aligned_unit), of_docs)))


def counted_pairs(texts: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether no other pair of its A id has more)."""
    pairs = checkpointed(texts.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.call_function("div", F.col("pair"), F.lit(PAIR))
    most = pairs.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary
    return checkpointed(pairs.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))


def scored_links(links: DataFrame, pairs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Rows with a pair, with its n and best; the most frequent pairs by broadcast, the others by key."""
    n_pairs = pairs.count()
    if n_pairs <= broadcast_pairs:
        return links.join(F.broadcast(pairs), "pair")
    # the least count that at most `broadcast_pairs` pairs reach; there are few different counts
    by_count = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("n")).limit(broadcast_pairs)
    least, held = None, 0
    for n, m in by_count.toLocalIterator():
        held += m
        if held > broadcast_pairs:
            break
        least = n
    if least is None:
        return links.join(pairs, "pair")
    frequent, rare = F.broadcast(pairs.filter(F.col("n") >= least)), pairs.filter(F.col("n") < least)
    met = links.join(frequent, "pair", "left")
    return met.filter(F.col("n").isNotNull()).unionByName(met.filter(F.col("n").isNull()).drop("n", "best").join(rare, "pair"))


def align(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, block_bytes: int = BLOCK_BYTES, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row for each document: its numbers, the digest of its groups, and its links' counts over the corpus."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/alignment-{uuid.uuid4()}"
    tokenised = blocks(docs, vocabulary or default_vocabulary(), pieces or default_pieces(), block_bytes)
    aligned(tokenised).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    texts = spark.read.parquet(folder)
    links = scored_links(texts.select("row", F.explode("links").alias("pair")), counted_pairs(texts), broadcast_pairs)
    scores = links.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    numbers = texts.select("row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256")
    return numbers.join(scores, "row", "left").fillna(0, ["n_best", "count_sum"]).select(*COLUMNS)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
