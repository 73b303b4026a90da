import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from querylens.llm._shared import checkpointed
from querylens.llm.quality import STATS, IsolationForest, calibrate, expected_path, features, fit, judge_stats, keep_good, op3_quality, report, text_stats, with_stats


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text("ab é#|<\n\t \x0b\x85\xa0\x1c", max_size=80)))
def test_stats_match_brute_force(text):
    assert text_stats(text)[:5] == brute(text)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    forest = IsolationForest(x)
    assert forest.score(np.array([[6.0, 0, 0], [0, -7.0, 1]])).min() > np.quantile(forest.score(x), 0.95)


def test_calibrate_keeps_good():
    good, bad = np.array([90, 9, 1, 0]), np.array([0, 0, 5, 5])
    assert calibrate(good, bad, 0.99) == 0.5
    assert calibrate(good, np.zeros(4)) == float("inf")


def test_judging_and_filter(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "tau", "rho", "pi"]
    rows = []
    for i in range(600):
        w = list(rng.choice(words, 80))
        if i % 10 == 3:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w) + f" x{i}", "extra"))
    rows += [(600, None, None), (601, "", ""), (None, "short", "n"), (5, rows[5][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anomaly string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 3 else 1) for i in range(300)] + [(None, 1), (4, None)], "doc_id long, quality int")
    stats = checkpointed(with_stats(docs))
    got = {r.doc_id: r for r in judge_stats(stats, fit(stats, labels)).collect()}
    assert got[600].base_failed and not got[600].kept and got[600].n_words == 0
    junk = [got[i].kept for i in range(300, 600) if i % 10 == 3]
    clean = [got[i].kept for i in range(300, 600) if i % 10 != 3 and not got[i].base_failed]
    assert sum(junk) == 0 and sum(clean) > 0.97 * len(clean)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in got if i is not None and got[i].kept] + ([5] if got[5].kept else []))
    seen = {r.quality: (r.n, r.n_kept) for r in report(stats, labels, fit(stats, labels)).collect()}
    assert seen[0][1] == 0 and seen[1][1] >= 0.9 * seen[1][0] and sum(n for n, _ in seen.values()) < 120
    none = stats.limit(0)
    assert judge_stats(none, fit(none, labels)).count() == 0
    assert len(STATS) == len(text_stats("x"))


def path_length(forest, t, x):
    """One row down one tree, step by step."""
    node = 0
    while forest.feature[t, node] >= 0:
        node = 2 * node + (1 if x[forest.feature[t, node]] <= forest.value[t, node] else 2)
    return forest.path[t, node]


def test_query_matches_a_walk_down_each_tree(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        w = rng.choices(["alpha", "Beta,", "gamma.", "delta", "omega", "tau", "rho", "pi"], k=rng.choice([20, 60, 90, 4000 if i == 7 else 70]))
        rows.append((i, " ".join(x + "$|" if i % 9 == 2 else x for x in w) + ("\nline\nline" if i % 5 == 0 else ""), "x"))
    rows += [(900, None, None), (901, "", ""), (None, "none " * 60, "n"), (5, rows[5][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 0 if i % 9 == 2 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = op3_quality(spark, str(tmp_path)).collect()
    assert {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"} <= set(got[0].asDict())
    stats = checkpointed(with_stats(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    model = fit(stats, labels)
    want = []
    for d, text, _ in rows:
        s = text_stats(text)
        assert s[:5] == brute(text)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        x = features(np.array([s]))[0]
        mean = sum(path_length(model.forest, t, x) for t in range(len(model.forest.feature))) / len(model.forest.feature)
        anomaly = 2 ** (-mean / expected_path(model.forest.rows))
        want.append((str(d), *s[:5], failed, not failed and anomaly < model.threshold, round(anomaly, 9)))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.anomaly, 9)) for r in got) == sorted(want)
