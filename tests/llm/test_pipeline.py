"""The pipeline's stages against brute force, each on its own input."""

import random
from collections import Counter, defaultdict

import public_tokenizers
from test_mixing_sharding_urls import brute_targets
from test_suffix_dedup import brute
from tokenizers import Tokenizer

import corpus_pipeline as cp
from querylens.llm import suffix_dedup


def corpus(rng):
    words = ["".join(rng.choices(["tion", "er", "an", "the", "is", "ou"], k=rng.randint(1, 4))) for _ in range(3000)]
    passage = " ".join(rng.choices(words, k=25))
    rows, junk, copies = [], set(), {}
    for i in range(240):
        t = rng.choices(words, k=rng.randint(80, 160))
        if i % 12 == 5:
            t = [w + "***" for w in t]
            junk.add(i)
        elif i % 12 == 7 and rows[i - 6][1]:
            t = rows[i - 6][1].split(" ")
            t[3] = "edited"
            copies[i] = i - 6
        elif i % 12 == 9:
            t[20:20] = passage.split(" ")
        rows.append((i, " ".join(t), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0))
    rows += [(500, None, "en", "a", None), (501, "", "en", "b", 0), (502, "short", None, "b", 5)]
    return rows, junk, copies


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows, junk, copies = corpus(rng)
    docs = spark.createDataFrame([(d, t, x, s, len(t or "")) for d, t, x, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i in junk else 1, 0) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(cp.STAGES) - 1:
            assert out[-1].columns == cp.COLUMNS
    ids = [[r.doc_id for r in o.select("doc_id").collect()] for o in out]
    clean = {r[0] for r in rows if r[0] < 500} - junk
    assert not set(ids[1]) & (junk | {500, 501, 502}) and len(set(ids[1]) & clean) >= 0.97 * len(clean)
    gone = {i for i, first in copies.items() if i in ids[1] and first in ids[1]}
    assert gone and set(ids[2]) == set(ids[1]) - gone
    before = sorted(out[2].collect(), key=lambda r: r.doc_id)
    want = {r.doc_id: b[0] - b[1] for r, b in zip(before, brute([(r.doc_id, r.text.encode()) for r in before], suffix_dedup.LENGTH), strict=True)}
    after = {r.doc_id: r for r in out[3].collect()}
    assert {d: len(r.text.encode()) for d, r in after.items()} == want and sum(want.values()) < sum(len(r.text.encode()) for r in before)
    assert all(r.n_chars == len(r.text) for r in after.values())
    sizes, taken, longest = Counter(), Counter(), defaultdict(int)
    for r in after.values():
        n = len(r.text.encode().split())
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for r in out[4].collect():
        taken[r.source] += len(r.text.encode().split())
    target = brute_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokens.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in out[4].collect())
    packed = out[5].collect()
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in packed) == total and len(held) <= -(-total // 1024) + 1
    assert all(sum(n for _, n in v) <= 1024 for v in held.values())
    assert cp.run(spark, str(tmp_path)).count() == len(packed)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
