import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from querylens.llm import suffix_tree_lm as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def brute_levels(texts, depth, least_share):
    levels = []
    everything = Counter()
    for t in texts:
        padded = b"\n" * depth + t
        for i in range(len(t)):
            everything[padded[i : i + depth + 1]] += 1
    total = sum(everything.values())
    for d in range(depth + 1):
        c = Counter()
        for g, n in everything.items():
            c[g[depth - d :]] += n
        context = Counter()
        for g, n in c.items():
            context[g[:-1]] += n
        rows = sorted((int.from_bytes(g, "big"), n) for g, n in c.items() if d == 0 or context[g[:-1]] >= max(1, least_share * total))
        levels.append((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))
    return levels


def brute_probability(levels, divergence):
    """A dictionary-based tree: context bytes -> distribution over 256 bytes."""
    table = []
    for d, (key, n) in enumerate(levels):
        t = {}
        for k, m in zip(key.tolist(), n.tolist(), strict=True):
            b = k.to_bytes(d + 1, "big")
            t.setdefault(b[:-1], Counter())[b[-1]] += m
        table.append(t)
    kept = {b""}
    for d in range(len(levels) - 1, 0, -1):
        for s, c in table[d].items():
            base = table[d - 1][s[1:]]
            n, m = sum(c.values()), sum(base.values())
            if sum(x * math.log((x / n) / (base[y] / m)) for y, x in c.items()) >= divergence:
                kept.update(s[i:] for i in range(d))
    dist = {}
    for s in sorted(kept, key=len):
        c = table[len(s)].get(s, Counter())
        n = sum(c.values())
        dist[s] = [((c[y] + 1) / (n + 256)) if not s else (c[y] + len(c) * dist[s[1:]][y]) / (n + len(c)) for y in range(256)]
    return dist


def test_automaton_matches_brute_force_tree():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["the", "and", "an", "tea", "é"], k=rng.randint(0, 30))).encode() + b"\n" for _ in range(60)]
    levels = brute_levels(texts, 3, 0.002)
    tree, dist = lm.SuffixTree(levels, 2.0), brute_probability(levels, 2.0)
    assert tree.n_contexts == len(dist) > 10
    assert all(abs(sum(p) - 1) < 1e-9 for p in dist.values())
    probe = [texts[0], b"\n", b"unseen zebra and tea\n", b"the and " * 300 + b"\n"]
    ends = np.cumsum([len(t) for t in probe])
    for t, end in zip(probe, ends, strict=True):
        got, want = float(tree.score(probe)[end - len(t) : end].sum(dtype=float)), 0.0
        for i, y in enumerate(t):
            h = (b"\n\n\n" + t)[i : i + 3]
            s = next(h[k:] for k in range(4) if h[k:] in dist)
            want += math.log10(dist[s][y])
        assert abs(got - want) < 1e-3 * max(1, abs(want))


def test_scores(spark, monkeypatch):
    rng = random.Random(2)
    parts = ["tion", "er", "an", "the", "is", "ou"]
    vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))).title(), "x") for i in range(400)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "A\x0bzzzz b \n", "x"), (None, "the the", "x"), rows[5], (1003, "the " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    training = docs.filter(~lm.held_out())
    counted = Counter(t for d, x, _ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(counted.values()), len(counted)
    want = sorted(
        (str(d), len(tokens(x)), sum(counted[t] > 0 for t in tokens(x)), n, round(sum(math.log10((counted[t] + 1) / (n + v + 1)) for t in tokens(x)), 4)) for d, x, _ in rows
    )
    for most in (1_000_000, 20):
        got = lm.score(docs, training, most_words=most).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        spell = lambda x: b"".join(t.encode() + b" " * (t != "\n") for t in tokens(x))
        tree = lm.SuffixTree(brute_levels([spell(x) for d, x, _ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2], lm.DEPTH, lm.LEAST_SHARE))
        mine = []
        for d, x, _ in rows:
            logs, at, total = tree.score([spell(x)]).astype(float), 0, 0.0
            for t in tokens(x):
                size = len(t.encode()) + (t != "\n")
                total += math.log10(lm.WORD_SHARE * counted[t] / n + (1 - lm.WORD_SHARE) * 10 ** logs[at : at + size].sum())
                at += size
            mine.append((str(d), round(total, 2)))
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 * max(10, abs(a[1])) for a, b in zip(sorted(mine), sorted((str(r.doc_id), r.score) for r in got), strict=True))
    assert lm.score(docs.limit(0), training).count() == 0
    assert lm.score(docs.limit(1), training.limit(0)).count() == 1


def test_query(spark, tmp_path):
    rows = [(i, f"Word{i % 7} and word{i % 5}", "en") for i in range(60)] + [(70, None, None), (None, "", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, held_out string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op4_suffix_tree_lm(spark, str(tmp_path))
    types = dict(got.dtypes)
    assert {k: types[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")} == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    got = got.collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2) for r in got)


def test_a_part_of_a_batch_that_ends_with_it_and_words_that_are_all_rare(spark):
    """Batches of a part's size leave nothing over, and a batch with no frequent word has sums of nothing."""
    docs = spark.createDataFrame([(0, "word " * (lm.BATCH_BYTES // 5 + 1))], "doc_id long, text string").coalesce(1)
    for most in (1_000_000, 0):
        (got,) = lm.score(docs, docs, most_words=most).collect()
        assert got.n_tokens == got.n_known == got.train_tokens == lm.BATCH_BYTES // 5 + 2 and isinstance(got.base_score, float)
    other = spark.createDataFrame([(1, "seldom")], "doc_id long, text string")
    assert lm.score(other, docs).first().n_known == 1
