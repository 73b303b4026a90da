import hashlib
import random

import numpy as np

from querylens.llm import suffix_dedup as sd


def brute(rows, length):
    """rows: (order, raw). Per row the kept bytes, number removed and spans."""
    least = {}
    for order, raw in rows:
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            least[w] = min(order, least.get(w, order))
    out = []
    for order, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < order:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n):
    words = ["tion", "the ", "er", "an ", "ñé", "que ", "\n", "\0", "x" * 30]
    passages = ["".join(rng.choices(words, k=30)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = ["".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            parts.insert(rng.randrange(len(parts) + 1), p[rng.randint(0, 20) : rng.randint(60, len(p) + 60)])
        texts.append("".join(parts))
    return texts + ["a" * 9000, "a" * 300, "a" * 120, "a" * 49, "a" * 50, texts[0], texts[0]]


def test_parts_and_merging_match_brute_force():
    rng = random.Random(1)
    for length in (50, 26, 60):
        for part_bytes in (400, 5000, sd.PART_BYTES):
            texts = [t.encode() for t in corpus(rng, 25)]
            rows = [(rng.randrange(12), t) for t in texts if len(t) >= length]
            order = np.array([r[0] for r in rows])
            windows = np.array([len(t) - length + 1 for _, t in rows])
            lost = sd.covered(order, windows, [t for _, t in rows], length, part_bytes)
            run, begin, stop = sd.stretches(lost, windows)
            assert len(run) + len(sd.stretches(~lost, windows)[0]) > len(rows) // 2
            for k, ((_, raw), want) in enumerate(zip(rows, brute(rows, length), strict=True)):
                spans = sd.merge_spans(begin[run == k], stop[run == k] + length - 1)
                kept = sd.cut_out(raw, spans)
                assert (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) == want


def test_parts_are_merged_by_binary_search(monkeypatch):
    """At default sizes: a bucket with runs of several shards looks its strings up in the parts before."""
    rng = random.Random(5)
    calls, find = [], sd.SortedStrings.find
    monkeypatch.setattr(sd.SortedStrings, "find", lambda self, part: (calls.append(len(part.at)), find(self, part))[1])
    texts = [bytes(rng.choices(b"abcdefgh", k=300_000)) for _ in range(12)]
    texts += [t[1000:200_000] for t in texts]
    windows = np.array([len(t) - 49 for t in texts])
    lost = sd.covered(np.arange(24), windows, texts, 50)
    assert len(calls) >= 2 and lost[: 12 * (300_000 - 49)].sum() == 0 and lost[12 * (300_000 - 49) :].all()


def test_common_prefixes():
    rng = random.Random(2)
    text = np.frombuffer("".join(rng.choices("ab", k=3000)).encode() + b"ab" * 200, np.uint8)
    starts = np.arange(len(text) - 49)
    part = sd.SuffixPart(text, starts, np.zeros(len(starts), np.int64), 50)
    raw = text.tobytes()
    suffixes = [raw[i : i + 50] for i in part.array.tolist()]
    assert suffixes == sorted(suffixes)
    want = [0] + [next((k for k in range(50) if a[k] != b[k]), 50) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    assert part._common_prefixes(part.array).tolist() == want


def test_runs_cover_each_window_once_and_meet():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choices(b"abcd ", k=200_000)), np.uint8)
    first, last, anchor = sd.runs(data)
    assert first[0] == 0 and last[-1] == len(data) - 49 and (first[1:] == last[:-1]).all()
    again = sd.runs(data[777:60_777])
    at = {int(a): int(h) for a, b, h in zip(first, last, anchor, strict=True) for a in range(int(a), int(b))}
    assert all(at[777 + w] == int(h) for a, b, h in zip(*again, strict=True) for w in range(int(a), int(b)))


def test_query_matches_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = [*corpus(rng, 120), None, ""]
    rows = [(rng.randrange(-5, 100) if i % 50 else None, t, "x") for i, t in enumerate(texts)]
    rows.append(rows[7])
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = brute([(sd.NULL_ID if d is None else d, (t or "").encode()) for d, t, _ in rows], 50)
    want = sorted(str((d, *w)) for (d, _, _), w in zip(rows, want, strict=True))
    assert sorted(str(tuple(r)) for r in sd.op2_suffix_dedup(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(sd, "HOT_DOCUMENTS", 3)
    assert sorted(str(tuple(r)) for r in sd.op2_suffix_dedup(spark, str(tmp_path)).collect()) == want
    cleaned = sd.remove_repeats(docs, bytes_per_shard=1000)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert {r.shard for r in cleaned.collect()} == {"x"}
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefghijklmnop ", k=2_600_000))
    rows = [(1, text), (2, text[1000:2_500_000]), (3, "x" * 60 + text[2_400_000:]), (2, text[5:])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in sd.op2_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 0), (2, 2_499_000, 1), (2, 2_599_995, 1), (3, 200_000, 1)]


def test_ids_at_the_ends_of_their_range(spark, tmp_path):
    """One text under null, 0, -1 and the greatest id, all in one shard: the smallest id keeps it, null comes last."""
    same = "one text that all of them hold, and that is longer than fifty bytes"
    for k, ids in enumerate([(None, 0, 5), (None, 0, -1, (1 << 63) - 1), (None, (1 << 63) - 1), (None, None), (-7, None, -8)]):
        rows = [(i, same, "e") for i in ids]
        spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = {r.doc_id: r.n_removed for r in sd.op2_suffix_dedup(spark, f"{tmp_path}/{k}").collect()}
        least = min((i for i in ids if i is not None), default=None)
        assert got == {i: 0 if i == least else len(same) for i in ids}
    kept = sd._Shard([None, 0, -1, 0], [same] * 4, 50)
    assert sorted(kept.order.values()) == [-2, -1, sd.NULL_ID]  # rows that are equal count once
