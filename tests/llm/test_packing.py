import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from querylens.llm.packing import END_ID, best_plan, cut, op9_packing, pack, pieces, plan, with_added

SCHEMA = "doc_id long, text string, extra string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_plan_places_every_rank_once(lengths):
    counts = Counter(lengths)
    p = plan(counts, 50)
    filled = Counter()
    seen = Counter()
    for i, length in enumerate(p["length"]):
        last = i + 1 == len(p["length"]) or p["length"][i + 1] != length
        n = (counts[length] if last else p["rank"][i + 1]) - p["rank"][i]
        seen[int(length)] += int(n)
        for k in range(n):
            filled[int(p["sequence"][i]) + k] += int(length)
    assert seen == counts and max(filled.values()) <= 50
    room = []  # first fit decreasing
    for x in sorted(lengths, reverse=True):
        k = next((k for k, free in enumerate(room) if free >= x), None)
        if k is None:
            room.append(50)
            k = -1
        room[k] -= x
    assert len(filled) <= len(room) + 1


def test_no_more_sequences_than_first_fit_decreasing():
    rng = random.Random(3)
    for n, low, high in ((1000, 1, 1023), (300, 1, 1023), (2000, 200, 500), (500, 1, 60), (40, 300, 700)):
        lengths = [rng.randint(low, high) for _ in range(n)]
        room = []
        for x in sorted(lengths, reverse=True):
            k = next((k for k, free in enumerate(room) if free >= x), None)
            if k is None:
                room.append(1024)
                k = -1
            room[k] -= x
        assert best_plan(Counter(lengths), 1024).size() <= 1.01 * len(room)


def test_added_tokens():
    encode = with_added(lambda t: [ord(c) for c in t], {"<a>": 1, "<a>b": 2})
    assert encode("x<a>y") == [120, 1, 121] and encode("<a>b<a>") == [2, 1] and encode("") == [] and with_added(list, {})("ab") == ["a", "b"]


def test_cut():
    assert cut(1, 4) == [(0, 1)]
    assert cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pack_round_trip(spark):
    texts = ["", None, "a b", "Hello, it's  me\n\nand\tyou é😀 12345 ", "word " * 3000, "same", "same", " x", "<|endoftext|>", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>x<|endof"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "z") for i, t in enumerate(texts)], SCHEMA)
    rows = pack(pieces(docs.union(docs.limit(1))), 1024).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4")
        got = by_doc[None if i == 3 else i][: 1 if i == 0 else None]
        assert [(r.piece, r.start, r.length) for r in got] == [(k, s, n) for k, (s, n) in enumerate(cut(len(ids), 1024))]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(by_sequence) == -(-total // 1024)


def test_empty(spark):
    assert pack(pieces(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_over_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = op9_packing(spark, sf)
    types = dict(got.dtypes)
    assert {k: types[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")} == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = got.collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, END_ID], "<u4")
        want += [(r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 1024))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        ends = [0, *(a + n for a, n in sorted(held))]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= 1024
    room = []  # first fit decreasing
    for x in sorted((r.length for r in rows), reverse=True):
        k = next((k for k, free in enumerate(room) if free >= x), None)
        if k is None:
            room.append(1024)
            k = -1
        room[k] -= x
    assert len(sequences) <= 1.01 * len(room), (len(sequences), len(room))
