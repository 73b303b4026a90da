import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from querylens.llm._shared import checkpointed
from querylens.llm import simhash as module
from querylens.llm.simhash import VantagePointTree, components, fingerprints, keep_one, roots, shard_links, simhash, with_components


def brute_simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, near):
    label = list(range(n))
    for _ in range(n):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return label


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.text("abÄZ \t\n\x1c\xa0", max_size=60)))
def test_simhash(text):
    assert simhash(text) == [brute_simhash(text)] and simhash(text, 4, 3)[0] == brute_simhash(text)


def clustered(rng, n):
    out = []
    for _ in range(n):
        x = rng.getrandbits(64) if not out or rng.random() < 0.4 else out[rng.randrange(len(out))]
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return np.array(sorted(set(out)), np.uint64)


def test_trees_and_shards_lose_no_link():
    rng = random.Random(4)
    for n, leaf in ((2, 2), (60, 2), (400, 8), (700, 64)):
        x = clustered(rng, n)
        near = [(i, j) for i in range(len(x)) for j in range(i) if (int(x[i]) ^ int(x[j])).bit_count() <= 4]
        a, b = VantagePointTree(x, leaf).pairs(4)
        assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == set(near)
        want = brute_components(len(x), near)
        assert roots(len(x), a, b).tolist() == want
        i, j = shard_links(x, np.zeros(len(x), np.int64), 4)
        assert roots(len(x), i, j).tolist() == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140)) and 0 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(150):
        t = rng.choices(words, k=rng.randint(5, 200))
        texts.append(" ".join(t))
        for _ in range(rng.choice([0, 0, 1, 4])):
            u = list(t)
            u[rng.randrange(len(u))] = "x"
            texts.append(" ".join(u).upper())
    texts += [None, "", "  \n", "two words", "two words"]
    rows = [(rng.randrange(10**9), t, "c") for t in texts] + [(None, texts[0], "c")]
    rows += [rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    prints = checkpointed(fingerprints(docs))
    fp = [brute_simhash(t) for _, t, _ in rows]
    near = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    label = brute_components(len(fp), near)
    least = {}
    for (d, _, _), k in zip(rows, label, strict=True):
        least[k] = min((x for x in (d, least.get(k)) if x is not None), default=None)
    want = sorted(str((d, least[k])) for (d, _, _), k in zip(rows, label, strict=True))
    assert sorted(str((r.doc_id, r.component_id)) for r in with_components(prints).collect()) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert with_components(prints.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0
    for name, value in (("POINTS_PER_KEY", 16), ("POINTS_PER_TASK", 20), ("agreeing", lambda n, r: 2)):
        monkeypatch.setattr(module, name, value)
        assert sorted(str((r.doc_id, r.component_id)) for r in with_components(prints).collect()) == want


def test_many_hashes_find_similar_texts_only(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for group in range(60):
        t = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for k, edits in enumerate((0, 1, 3, 60)):
            u = list(t)
            for _ in range(edits):
                u[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            rows.append((group * 10 + k, " ".join(u)))
            want[group * 10 + k] = group * 10 + (3 if k == 3 else 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = checkpointed(fingerprints(docs, 5, hashes=6))
    got = {r.doc_id: r.component_id for r in with_components(prints, 8, 6, 0.8).collect()}
    assert sum(got[d] == want[d] for d in want) >= 0.99 * len(want)
    assert sorted(r.doc_id for r in keep_one(docs, 5, 8, 6, 0.8).collect()) == sorted(set(got.values()))


def shingle_set(text, k=5):
    w = text.lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_similar_texts_are_linked_by_exact_jaccard(spark, monkeypatch):
    rng = random.Random(10)
    line = [f"line{i}" for i in range(12)]
    texts = []
    for _ in range(60):
        t = [f"w{rng.randrange(10**6)}" for _ in range(100)] + line
        texts.append(t)
        for edits in (2, 3, 4):
            u = list(t)
            for at in rng.sample(range(100), edits):
                u[at] = f"x{rng.randrange(10**6)}"
            texts.append(u)
    texts = [" ".join(t) for t in texts]
    sets = [shingle_set(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert 20 < len(near) < 300
    want = sorted(set(brute_components(len(texts), near)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(docs, 5, 8, 6, 0.8).collect()) == want
    monkeypatch.setattr(module, "MANY", 2)
    assert sorted(r.doc_id for r in keep_one(docs, 5, 8, 6, 0.8).collect()) == want
    monkeypatch.setattr(module, "COMMON", 10**9)
    assert sorted(r.doc_id for r in keep_one(docs, 5, 8, 6, 0.8).collect()) == want
    assert keep_one(docs.limit(0), 5, 8, 6, 0.8).count() == 0


def test_a_repeated_line_does_not_link_different_texts(spark):
    rng = random.Random(12)
    line = " ".join(f"line{i}" for i in range(10)) + "\n"
    rows = [(d, line * 100 + " ".join(f"w{rng.randrange(10**7)}" for _ in range(3000))) for d in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(docs, 5, 8, 6, 0.8).collect()) == [0, 1, 2, 3]


def test_repeated_and_null_ids_keep_one_row_of_each_component(spark):
    rng = random.Random(11)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(3)]
    near = [" ".join(["x", *t[1:]]) for t in texts]
    texts = [" ".join(t) for t in texts]
    rows = [(7, texts[0]), (8, near[0]), (7, texts[1]), (9, near[1]), (None, texts[2]), (None, near[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (0.8, None):
        kept = [(r.doc_id, r.text) for r in keep_one(docs, similarity=similarity).collect()]
        assert len(kept) == 3 and {(7, texts[0]), (7, texts[1])} < set(kept) and {i for i, _ in kept} == {7, None}


def test_every_link_comes_from_a_tree(monkeypatch):
    x = clustered(random.Random(14), 3000)
    keys = (x >> np.uint64(62)).astype(np.int64)
    found, pairs = [], VantagePointTree.pairs

    def counted(self, radius):
        a, b = pairs(self, radius)
        found.extend(zip(self.points[a].tolist(), self.points[b].tolist(), strict=True))
        return a, b

    monkeypatch.setattr(VantagePointTree, "pairs", counted)
    a, b = shard_links(x, keys, 4)
    assert len(a) > 100
    linked = {p for pair in found for p in pair}
    assert {*x[a].tolist(), *x[b].tolist()} <= linked
    monkeypatch.setattr(VantagePointTree, "pairs", lambda self, radius: (np.zeros(0, np.int64),) * 2)
    assert not len(shard_links(x, keys, 4)[0])


def test_trees_prune():
    """Comparisons of a tree against all pairs, for unrelated points."""
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000).astype(np.uint64))
    done = []

    class Counting(VantagePointTree):
        def _direct(self, a, b, *rest):
            done.append(len(a) * len(b) if len(b) else len(a) * (len(a) - 1) // 2)
            super()._direct(a, b, *rest)

    Counting(x).pairs(4)
    assert sum(done) < 0.75 * len(x) * (len(x) - 1) / 2


def test_query(spark, tmp_path):
    rows = [(5, "A b c d e"), (3, "a B C d e"), (4, "other words than these here"), (None, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = module.op6_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()}
    assert got == {d: (f"{brute_simhash(t):016x}", c) for (d, t), c in zip(rows, (3, 3, 4, 9, 9), strict=True)}


def test_a_spanning_forest_stands_for_very_many_pairs(monkeypatch):
    x = clustered(random.Random(15), 500)
    a, b = VantagePointTree(x, 8).pairs(4)
    want = roots(len(x), a, b).tolist()
    monkeypatch.setattr(module, "MOST_PAIRS", 20)
    c, d = VantagePointTree(x, 8).pairs(4)
    assert len(c) < len(a) and roots(len(x), c, d).tolist() == want


def test_near_duplicates_are_linked_by_trees_of_fingerprints(spark, monkeypatch):
    """Trees alone link near copies, and what they give is what brute force finds in each key."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64)
    prints = np.stack([np.concatenate([base, base ^ np.uint64(0b101), base ^ np.uint64((1 << 9) - 1)]), rng.integers(0, 1 << 63, 1200, dtype=np.int64).astype(np.uint64)], 1)
    node, key = rng.permutation(1200).astype(np.int64), rng.integers(0, 90, 1200) ** 2 // 180
    size, bits = np.full(1200, 100), np.zeros((1200, module.PARITIES // 64), np.uint64)
    want, linked = set(), set()
    for j in range(1200):
        near = [node[i] for i in range(1200) if key[i] == key[j] and node[i] < node[j] and (np.bitwise_count(prints[i] ^ prints[j]) <= 8).any()]
        want |= {(min(near), node[j])} if near else set()
        linked |= {(i, node[j]) for i in near}
    for many, per_key in ((8, 1024), (2, 16)):
        monkeypatch.setattr(module, "MANY", many)
        monkeypatch.setattr(module, "POINTS_PER_KEY", per_key)
        got = set(zip(*module.tree_pairs(key, node, size, bits, prints, 0.8, 8), strict=True))
        assert len(want) > 20 and (got <= linked and len(got) > 0.8 * len(want) if many == 2 else got == want)
    crowd = np.uint64(7) ^ np.uint64(1) << np.arange(64, dtype=np.uint64)
    a, b = module.near_points(np.unique(crowd), 8)
    assert len(a) < 64 * 64 and set(range(64)) == set(a.tolist()) | set(b.tolist())
    texts = [" ".join(f"w{g}x{k}" for k in range(200)) for g in range(40)]
    sets = module._lists(pa.array([*texts, "", None]), 5)
    got = module.set_fingerprints(sets.offsets.to_numpy(), sets.values.to_numpy(), 3)
    assert got.tolist() == [simhash(t, 5, 3) for t in [*texts, "", None]]
    monkeypatch.setattr(module, "candidate_pairs", lambda rows, similarity: rows.sparkSession.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame([(2 * g + k, t.replace("x100 ", "y ") if k else t) for g, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(docs, 5, 8, 6, 0.8).collect()) == list(range(0, 80, 2))
