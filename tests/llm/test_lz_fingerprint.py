import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from querylens.llm.lz_fingerprint import Parser, fingerprint, fingerprint_with_next, likeness, op7_lz_fingerprint, phrase_hashes, signatures


def brute_phrases(data):
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def spell(p):
    out = [b""]
    for parent, c in zip(p.parents, p.symbols, strict=True):
        out.append(out[parent] + bytes([c]))
    return set(out[1:])


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=120), st.integers(0, 120))
def test_parse_matches_brute_force(text, cut):
    data = text.encode()
    p = Parser().feed(data[:cut]).copy().feed(data[cut:])
    assert spell(p) == brute_phrases(data)
    h, owner = phrase_hashes([p, Parser(), p])
    assert len(set(h.tolist())) == len(p.parents) and (h[owner == 0] == h[owner == 2]).all()


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(300)]
    for share in (0.0, 0.3, 0.7, 1.0):
        a = " ".join(rng.choices(words, k=600)).encode()
        b = a[: int(len(a) * share)] + " ".join(rng.choices(words, k=600)).encode()[: len(a) - int(len(a) * share)]
        pa_, pb = brute_phrases(a), brute_phrases(b)
        s = signatures([Parser().feed(a), Parser().feed(b)])
        assert abs(likeness(s[:1], s[1:])[0] - len(pa_ & pb) / len(pa_ | pb)) < 0.15


def test_order_edits_and_edges(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choices(["uno", "dué", "tres", "x"], k=rng.randint(0, 40)))) for i in range(50)]
    rows += [(500, None), (501, ""), (502, "y" * 5000), (3, rows[1][1]), (None, "null id"), (-7, "z")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, fingerprint string")
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited)))
    for parts in (1, 2, 7):
        got = fingerprint_with_next(docs, parts).collect()
        assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
        assert all(r.near_edited == 1 for r in got if r.n_chars < 2)
    assert fingerprint("") == "00" * 128 and fingerprint_with_next(docs.limit(0)).count() == 0
    only = fingerprint_with_next(docs.filter("doc_id = 502")).collect()
    assert len(only) == 1 and only[0].near_next == 1
    nulls = fingerprint_with_next(docs.filter("doc_id is null")).collect()
    assert len(nulls) == 1
    assert likeness(np.zeros((1, 128), np.uint8), np.ones((1, 128), np.uint8))[0] == 0


def brute_signature(data, slots=128):
    """Scalar: hash of each phrase, least hash of each slot, empty slots from the next filled one."""
    wrap = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & wrap
        h = (h ^ h >> 27) * 0x94D049BB133111EB & wrap
        return h ^ h >> 31

    least = {}
    for phrase in brute_phrases(data):
        h = 0
        for c in phrase:
            h = (h * 0x9E3779B97F4A7C15 + c + 1) & wrap
        h = mix(h)
        least[h % slots] = min(h, least.get(h % slots, wrap))
    if not least:
        return bytes(slots)
    out = []
    for i in range(slots):
        k = next(k for k in range(slots) if (i + k) % slots in least)
        lent = least[(i + k) % slots]
        out.append(mix(mix((lent + k) & wrap) if k else lent) & 255)
    return bytes(out)


def test_signatures_match_brute_force():
    rng = random.Random(5)
    for n in (0, 1, 2, 30, 400, 5000):
        data = bytes(rng.choices(b"abc de\xc3\xa9", k=n))
        assert signatures([Parser().feed(b"other"), Parser().feed(data)])[1].tobytes() == brute_signature(data)


def test_query(spark, tmp_path):
    rows = [(1, "abc abc"), (2, None), (3, "é" * 11)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_lz_fingerprint(spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = {r.doc_id: r for r in got.collect()}
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == {
        1: (7, hashlib.sha256(("abc " + "é" * 3).encode()).hexdigest()),
        2: (0, hashlib.sha256(b"").hexdigest()),
        3: (11, hashlib.sha256(("é" * 6).encode()).hexdigest()),
    }
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))
