import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from querylens.llm import alignment, divergence, registry, secrets
from querylens.llm._shared import checkpointed

SCHEMA = "doc_id long, text string, lang string, source string, value string, row string, term string, kind string"


def rows_of(texts):
    return [(i, t, lang, source, "e", "e", "e", "e") for i, (t, lang, source) in enumerate(texts)]


def against_sql(spark, name, folder):
    got = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    found = [tuple(r) for r in got.select(columns).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()))
    return got


def brute_audit(rows, ranks):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = [(lang or "", source or "", re.findall(divergence.TERM, lower(text or ""))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {x for x, _, _ in docs}:
        mine = [(s, t) for x, s, t in docs if x == lang]
        df = Counter(w for _, t in mine for w in set(t))
        kept = {w for w, n in df.items() if n >= 3}
        count = defaultdict(Counter)
        for s, t in mine:
            count[s].update(w for w in t if w in kept)
        total = sum((c for c in count.values()), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) * (p - q) // q
        for s, c in count.items():
            pairs = [(sum(f(share(c, w), share(d, w)) for w in kept), o) for o, d in count.items() if o != s]
            terms = [(f(share(c, w), share(total, w)), w) for w in kept if c[w] and share(c, w) > share(total, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, v, k + 1))
    return out


def audit_rows():
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "abcdé" for b in "eou" for c in ("", "n", "ß", "日本")]
    texts = [(" ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 60))).title(), rng.choice(["en", "de", None]), rng.choice(["a", "B", "ä", None, "z"])) for _ in range(120)]
    return rows_of([*texts, (None, "fr", "a"), ("", "fr", None), ("only here", "fr", "q"), ("x" * 30000, "en", "a"), *[("tie tie2 " + " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)), "es", s) for s in ("a", "b", "b", "c")], texts[5], texts[5]])


def test_divergence(spark, tmp_path, monkeypatch):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = against_sql(spark, "op11_divergence", str(tmp_path))
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == brute_audit(rows, 200)
    # few ranks, digits and bins of one row: every round of the selection is taken
    monkeypatch.setattr(divergence, "DIGIT_BITS", 5)
    monkeypatch.setattr(divergence, "LAST_BIN", 1)
    monkeypatch.setattr(divergence, "BLOCK_PAIRS", 7)
    few = divergence.audit(docs, ranks=4)
    assert {tuple(r) for r in few.select("lang", "source", "part", "item", "value", "rank").collect()} == brute_audit(rows, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_radix_selection_of_ties(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LAST_BIN", 2)
    rows = [("l", "s", "é" * 9 + chr(97 + k % 26) * (k // 26), 7) for k in range(300)] + [("l", "s", f"a{k}", 2**40 + k) for k in range(5)] + [("l", "t", "one", 0)]
    rows = [r for k, r in enumerate(rows) if r[2] not in {x[2] for x in rows[:k] if x[1] == r[1]}]
    got = divergence.radix_select(checkpointed(spark.createDataFrame(rows, "lang string, source string, item string, value long")), 40)
    want = sorted((r for r in rows if r[1] == "s"), key=lambda r: (-r[3], r[2].encode()))[:40]
    assert [(r.lang, r.source, r.item, r.value) for r in got.filter("source = 's'").orderBy("rank").collect()] == want
    assert [r.rank for r in got.filter("source = 't'").collect()] == [1]


def test_shares_of_large_counts(spark):
    got = spark.range(1).select(divergence.share(divergence.F.lit(3 * 10**12), divergence.F.lit(7 * 10**14 + 1)).alias("p")).first().p
    assert got == 1 + 10**9 * (3 * 10**12 + 1) // (7 * 10**14 + 1)


def brute_spans(text):
    found = []
    for m in re.finditer(secrets.ASSIGN, text):
        n = len(m[2])
        found += [("assign", *m.span())] if n >= 8 else [("short", *m.span())] if n >= 4 else []
    found += [("access", *m.span()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found += [("key_id", *m.span()) for m in re.finditer(secrets.KEY_ID, text) if len(m[0]) >= 8 and not (m[0].startswith("AKIA") and len(m[0]) >= 16)]
    found += [("login", *m.span()) for m in re.finditer(secrets.LOGIN, text)]
    found += [("mixed", *m.span()) for m in re.finditer(secrets.MIXED, text) if all(re.search(c, m[0]) for c in secrets.MIXED_CLASSES)]
    found += [("endpoint", *m.span()) for m in re.finditer(secrets.ENDPOINT, text)]
    base = [x for x in found if x[0] in secrets.BASE]
    found = [x for x in found if x[0] in secrets.BASE or not any(b[1] <= x[1] and b[2] >= x[2] for b in base)]
    part = {k: v[1] for k, v in secrets.KINDS.items()}

    def near(x, which, among):
        return any(part[y[0]] == which and y[2] >= x[1] - secrets.SCOPE and y[1] <= x[2] + secrets.SCOPE for y in among)

    out = list(base)
    for x in found:
        if x[0] in secrets.BASE:
            continue
        others = {"identifier": "secret", "secret": "identifier"}
        if part[x[0]] == "endpoint":
            linked = near(x, "identifier", found) and near(x, "secret", found)
        else:
            linked = near(x, others[part[x[0]]], base) or (near(x, others[part[x[0]]], found) and near(x, "endpoint", found))
        out += [x] if linked else []
    order = list(secrets.KINDS)
    label = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(xs, key=lambda x: (x[1], order.index(x[0]))))
    counts = Counter(x[0] for x in base)
    return (*[counts[k] for k in secrets.BASE], hashlib.sha256(label(base).encode()).hexdigest(), label(out))


def secret_texts():
    rng = random.Random(5)
    parts = [
        "password=hunter2", "Passwd: 'abcdefgh1'", "token=secret: abcdefghijk", "API_KEY = \"x/y+z==\"", "apikey:12345678", "secret==aaaaaaaa", "AKIA" + "Q7" * 8, "AKIAAKIAAKIASHORT"[:14], "ASIAABCDEF123", "xAKIAAKIA0123456789",
        "0123456789abcdef" * 2, "deadbeef" * 5, "f" * 31, "user: bob", "Login = alice@corp", "client_id=9f8e", "wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY", "https://db.example.com:5432/x?y=1", "postgres://h/db", "s3://bucket/key",
        "日本語", "é", "\n\n", "word", "toKen = abcdefghij", "token: " + "q" * 5000, "token = \"" + "ab" * 20 + "\"", "🙂🙂",
    ]
    texts = ["", None, *parts]
    for _ in range(150):
        gap = rng.choice([" ", " " * 150, " filler" * 40])
        texts.append(gap.join(rng.choices(parts, k=rng.randint(1, 9))))
    return [*texts, texts[40], ("token=aaaaaaaa " * 3000) + "user: bob"]


def test_secrets(spark, tmp_path):
    rows = rows_of([(t, "en", "s") for t in secret_texts()])
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = against_sql(spark, "op12_secrets", str(tmp_path))
    assert len(got.columns) == 6
    for r in got.collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == brute_spans(rows[r.doc_id][1] or ""), rows[r.doc_id][1]
    linked = " ".join(r.spans for r in got.collect())
    assert all(f"{kind}:" in linked for kind in secrets.KINDS)
    assert secrets.scan_secrets(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True  # their strings inside texts are plain text
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    bytes_of = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    for b in range(256):
        bytes_of[chr(b) if b in printable else chr(next(others))] = b
    assert decoders.ByteLevel().decode(["Ġa"]) == " a"
    docs = []
    for doc_id, text, *_ in rows:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(bytes_of[c] for c in first.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        if text and (b"".join(a_bytes) != f" {text}".encode() or b"".join(b_bytes) != f" {text}".encode()):
            a = b = []
        groups, i, j, x, y = [], 0, 0, 0, 0
        while i < len(a):
            ga, gb = [], []
            while True:
                if x <= y and not (x == y and ga):
                    ga.append(a[i])
                    x += len(a_bytes[i])
                    i += 1
                elif y < x:
                    gb.append(b[j])
                    y += len(b_bytes[j])
                    j += 1
                if x == y:
                    break
            groups.append((ga, gb))
        docs.append((doc_id, a, b, groups))
    counts = Counter()
    for *_, groups in docs:
        counts.update({(p, q) for ga, gb in groups for p in ga for q in gb})
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for doc_id, a, b, groups in docs:
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return out




@pytest.mark.parametrize(("block", "broadcast"), [(alignment.BLOCK_BYTES, alignment.BROADCAST_PAIRS), (300, 40), (300, 0)])
def test_alignment(spark, block, broadcast):
    rng = random.Random(7)
    words = ["the", "Wörter", "naïve", "日本語", "don't", "<|endoftext|>", "</s>", "<0x41>", "a\tb", "12345", "🙂", "x.y", "\n", "", " ", "antidisestablishmentarianism", "é", " ", "\x00", "ﬁ", "\r\n", " ", "\x1f"]
    texts = [None, "", " ", "  two  spaces ", "\nline\n", "has ▁ in it", "▁", "a" * 5000, " lead", "trail ", "word"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(80)]
    texts += [texts[20], "the " * 4000]
    rows = rows_of([(t, "en", "s") for t in texts])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = alignment.align(docs, block_bytes=block, broadcast_pairs=broadcast)
    assert got.columns == alignment.COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(brute_alignment(rows))
    assert alignment.align(docs.limit(0)).count() == 0


def test_alignment_uses_python_for_tokens_only(spark, tmp_path):
    spark.createDataFrame(rows_of([("one two", "en", "s")]), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    plan = registry.QUERIES["op13_alignment"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_alignment_of_a_unit_by_its_own_tokens(spark, monkeypatch):
    rows = rows_of([(t, "en", "s") for t in ["one antidisestablishmentarianism one", "Wörter日本語 one"]])
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    (block,) = alignment.blocks(docs, alignment.default_vocabulary(), alignment.default_pieces()).collect()
    assert len(block.units) == 3 and sum(len(d.units) for d in block.docs) == 5
    assert all(u.a_ends[-1] == u.b_ends[-1] and len(u.a_ids) == len(u.a_ends) and len(u.b_ids) == len(u.b_ends) for u in block.units)
    for tokens in (0, 1000):  # cuts placed by merging, by searching
        monkeypatch.setattr(alignment, "SEARCHED", tokens)
        assert sorted(map(tuple, alignment.align(docs).collect())) == sorted(brute_alignment(rows))
