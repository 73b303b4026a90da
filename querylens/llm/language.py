"""Language identification by cross-parsing.

Each language has a suffix automaton of its labelled sample: a walk along its transitions spells just the sample's
substrings. A text is parsed against it into phrases, each the longest match from where the one before ended. The fewer
phrases, relative to the length, the better the language's sample describes the text; the least count wins.

The automata are fitted on a bounded sample: of every language at most DOCS_PER_LANGUAGE labelled documents (the ones with the
least digests of id and text; equal ones count once), fewer where there are so many languages that SAMPLE_DOCS would be
passed, and CHARS_PER_LANGUAGE symbols, shared out over the documents; with many languages the symbols are cut so that all
tables together hold about TOTAL_CHARS. The tables are broadcast; this is their size bound.

Predictions read whole texts. A text is parsed in blocks of BLOCK symbols, many blocks in step, so the parse is a few array
operations for each position rather than a Python loop for each symbol. All blocks start at the root first. Then each that
follows another one is parsed from the state that this one ended in: two parses of one block are the same from the first
place on where both are in one state, mostly within PROBE symbols, so only these are parsed again, and the whole block where
that isn't so. It goes on until no block's state at its start changes. Phrases are then those of whole texts.

Symbols: letters in lower case; every run of other characters is one space. Defined results: `und` and score 0 for a null
text or one without a letter, and where nothing was learned; ties go to the language that sorts first; a row with a null
id is held out. Repeated rows get equal results, extra columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.llm._shared import table

DOCS_PER_LANGUAGE = 64
SAMPLE_DOCS = 16_384  # of all languages, but at least one of each
BROADCAST_DRAWS = 100_000
CHARS_PER_LANGUAGE = 16_384
TOTAL_CHARS = 1_000_000
BLOCK = 512
PROBE = 64  # symbols of a block
BATCH_SYMBOLS = 4_000_000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter. One for each Python process."""
    if not _letters:
        lower = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                lower[i] = ord(low) if len(low) == 1 else i
        _letters.append(lower)
    return _letters[0]


def symbols(text: str | None) -> np.ndarray:
    """Lower-case letters with single spaces between the words; empty without a letter."""
    s = letters()[np.frombuffer((text or "").encode("utf-32-le"), "<u4")]
    gap = s == 32
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    s = s[keep]
    return s if len(s) > 1 or (len(s) and s[0] != 32) else s[:0]


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in s:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class LanguageModel:
    """Dense transition tables of the languages' automata over one alphabet.

    Symbol 0 is padding and keeps the state, 1 stands for any letter that no sample has. A table's entry is the offset of the
    next state's row; where the match ends there, it is the complement of the offset that the new phrase goes on from.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        each = min(CHARS_PER_LANGUAGE, TOTAL_CHARS // max(1, len(samples)))
        parts = {k: [symbols(t)[: max(1, each // len(samples[k]))] for t in sorted(samples[k])] for k in self.languages}
        seen = sorted({int(c) for p in parts.values() for x in p for c in np.unique(x)})
        self.number = {c: k + 2 for k, c in enumerate(seen)}
        self.width = len(seen) + 2
        self.tables = [self._table(parts[k]) for k in self.languages]

    def _table(self, parts: list[np.ndarray]) -> np.ndarray:
        s = [self.number[int(c)] for x in parts for c in x]
        go = suffix_automaton(s)
        out = np.full((len(go), self.width), -1, np.int32)  # ~0: a new phrase, from the root
        for c, q in go[0].items():
            out[:, c] = ~(q * self.width)
        for p, to in enumerate(go):
            for c, q in to.items():
                out[p, c] = q * self.width
        out[:, 0] = np.arange(len(go)) * self.width
        return out.ravel()

    def encode(self, text: str | None) -> np.ndarray:
        s = symbols(text)
        low = np.minimum(s, len(self._lut) - 1)
        return np.where(s < len(self._lut), self._lut[low], 1).astype(np.uint8 if self.width < 256 else np.uint32)

    @property
    def _lut(self) -> np.ndarray:
        if not hasattr(self, "_lut_"):
            self._lut_ = np.ones(max(self.number, default=32) + 1, np.uint32)
            self._lut_[list(self.number)] = list(self.number.values())
        return self._lut_

    @staticmethod
    def _parse(table: np.ndarray, steps: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the steps (rows: one symbol of every block), and how many phrases ended on the way."""
        count = np.zeros(len(state), np.int32)
        for row in steps:
            state = table[state + row]
            ended = state >> 31
            count -= ended
            state = state ^ ended
        return state, count

    def phrases(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases that end in each block (rows, padded with 0) in each language; `first` marks blocks that begin a text."""
        steps = np.ascontiguousarray(blocks.T)
        out = np.zeros((len(self.tables), blocks.shape[0]), np.int64)
        for k, t in enumerate(self.tables):
            start = np.zeros(blocks.shape[0], np.int32)
            middle, early = self._parse(t, steps[:PROBE], start)
            end, late = self._parse(t, steps[PROBE:], middle)
            while True:
                carried = np.where(first, 0, np.concatenate([start[:1] * 0, end[:-1]])).astype(np.int32)
                changed = np.flatnonzero(carried != start)
                if not len(changed):
                    break
                start = carried
                state, early[changed] = self._parse(t, steps[:PROBE][:, changed], carried[changed])
                apart = changed[state != middle[changed]]
                middle[changed] = state
                if len(apart):
                    end[apart], late[apart] = self._parse(t, steps[PROBE:][:, apart], middle[apart])
            out[k] = early + late
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [self.encode(t) if self.languages else np.zeros(0, np.uint8) for t in texts]
        n_blocks = np.array([-(-len(c) // BLOCK) for c in coded])
        blocks = np.zeros((int(n_blocks.sum()), BLOCK), coded[0].dtype if coded else np.uint8)
        flat, at = blocks.reshape(-1), 0
        for c, n in zip(coded, n_blocks, strict=True):
            flat[at : at + len(c)] = c
            at += int(n) * BLOCK
        owner = np.repeat(np.arange(len(coded)), n_blocks)
        per_block = self.phrases(blocks, np.diff(owner, prepend=-1) > 0)
        names, scores = [], []
        total = np.zeros((len(texts), len(self.tables)))
        for k in range(len(self.tables)):
            total[:, k] = 1 + np.bincount(owner, per_block[k], len(texts))
        for c, counts in zip(coded, total, strict=True):
            if not len(c) or not len(counts):
                names.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(counts))
            names.append(self.languages[best])
            rest = np.delete(counts, best)
            scores.append(float(1 - counts[best] / rest.min()) if len(rest) else 1.0)
        return names, scores


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fit on rows with doc_id, text and lang; rows without a lang or text are left out."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    labelled = labelled.select("lang", F.xxhash64("doc_id", "text").alias("draw"), "text")
    languages = labelled.agg(F.count_distinct("lang")).first()[0]
    docs_per_language = max(1, min(docs_per_language, SAMPLE_DOCS // max(1, languages)))
    first = Window.partitionBy("lang").orderBy("draw")
    # each task keeps its own first rows before the shuffle, so a language that most rows have moves no more than others
    drawn = labelled.select("lang", "draw").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= docs_per_language)
    chosen = drawn.select("lang", "draw").distinct()
    if languages * docs_per_language <= BROADCAST_DRAWS:
        chosen = F.broadcast(chosen)
    samples: dict[str, list[str]] = {}
    texts = labelled.join(chosen, ["lang", "draw"]).dropDuplicates(["lang", "draw"])
    share = min(CHARS_PER_LANGUAGE, 64 * max(1, TOTAL_CHARS // max(1, languages)))  # of what is read of each, a part is taken
    for r in texts.select("lang", F.substring("text", 1, share).alias("text")).collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return LanguageModel({k: v for k, v in samples.items() if any(len(symbols(t)) for t in v)})


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, texts, held, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BATCH_SYMBOLS:
                    held.append((ids, *m.predict(texts)))
                    ids, texts, size = [], [], 0
            held.append((ids, *m.predict(texts)))
            for ids, names, scores in held:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs.filter(~held_out()))).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
