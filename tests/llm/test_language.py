import random

from hypothesis import given, settings
from hypothesis import strategies as st

from querylens.llm import language
from querylens.llm.language import LanguageModel, fit, op8_language, predict, suffix_automaton, symbols

PARTS = {"aa": ["the", "and", "ing", "tion", "er"], "bb": ["que", "ción", "los", "ado", "ñe"], "cc": ["sch", "ung", "ein", "ä", "keit"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 3), max_size=12))
def test_automaton_spells_just_the_substrings(s, probe):
    go, state = suffix_automaton(s), 0
    for c in probe:
        state = go[state].get(c) if state is not None else None
    there = any(s[i : i + len(probe)] == probe for i in range(len(s) - len(probe) + 1))
    assert (state is not None) == there


def brute_phrases(sample, s, known):
    """Longest matches, each from where the one before ended; a symbol the sample lacks ends one and is in none."""
    n, i = 1, 0
    while i < len(s):
        k = 0
        while i + k < len(s) and any(sample[j : j + k + 1] == s[i : i + k + 1] for j in range(len(sample) - k)):
            k += 1
        i += k
        if i < len(s):
            n += 1
            i += s[i] not in known
    return n


def test_phrases_match_brute_force(monkeypatch):
    rng = random.Random(3)
    sample = sentence(rng, "aa", 40)
    texts = [sentence(rng, "aa", 30) + " " + sentence(rng, "bb", 10), sentence(rng, "bb", 60), sentence(rng, "aa", 200), "a", sample * 3, "the" * 90, "\u00e9" * 50 + "the"]
    for block, probe in ((512, 64), (32, 4), (16, 16), (7, 1), (1, 1)):
        monkeypatch.setattr(language, "BLOCK", block)
        monkeypatch.setattr(language, "PROBE", probe)
        model = LanguageModel({"aa": [sample], "bb": [sentence(random.Random(9), "bb", 40)]})
        own = [model.number.get(c, 1) for c in symbols(sample).tolist()]
        want = [brute_phrases(own, model.encode(t).tolist(), set(own)) for t in texts]
        counted = []
        monkeypatch.setattr(language.np, "argmin", lambda counts, found=counted: found.append(counts[0]) or 0)
        model.predict(texts)
        monkeypatch.undo()
        assert counted == want


def test_no_language_is_dropped(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k}": [letters[k // 26 % 26] + letters[k % 26] + w for w in ("x", "yz", "q")] for k in range(300)}
    rows = [(k, " ".join(rng.choices(words[lang], k=30)), lang) for k, lang in enumerate(words)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300
    got = model.predict([" ".join(rng.choices(words[f"l{k}"], k=40)) for k in (0, 150, 299)])[0]
    assert got == ["l0", "l150", "l299"]


def test_held_out_accuracy_and_edges(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, 30), lang, "x") for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa", "x"), (901, "", None, "x"), (902, "12 .. 34", "bb", "x"), (903, sentence(rng, "bb", 4000), None, "x"), (None, rows[0][1], "aa", "x"), rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "bb" and by[None].held_out
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert predict(docs, fit(docs)).collect()[0].lang_pred == "und"
    assert predict(docs.limit(0), fit(docs.limit(0))).count() == 0
