import re

import numpy as np
from pyspark.sql import functions as F

from tabsmith.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    """The five counts of the contract by plain loops."""
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, None if cover is None else len(cover)


def test_counts_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    texts += [None, "", " \n ", "a", "a b", "a b c a b c", "x x x x", "é é é\n\n\né é é\n x \nx\n x ", "\x0b\x0c\r a|b<>", "a a a\na a a"]
    for t in texts:
        got, want = Q.text_counts(t)[:5], brute_counts(t)
        assert got[:4] == want[:4] and (want[4] is None or got[4] == want[4]), t


def test_rules_are_learned_in_order_and_pruned():
    rng = np.random.default_rng(1)
    n = 4000
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.1) & (x["c"] > 0.5))
    rules = Q.learn_rules(x, bad)
    out = np.zeros(n, bool)
    for r in rules:
        assert 1 <= len(r) <= Q.MAX_CONDITIONS
        out |= Q._covered(r, x)
    assert (out == bad).mean() > 0.97 and (out & ~bad).mean() < 0.02
    assert Q.learn_rules(x, np.zeros(n, bool)) == [] and Q.learn_rules(x, rng.random(n) < 0.1) == []


def test_weights_stand_for_repeated_rows():
    rng = np.random.default_rng(3)
    x = {"a": rng.integers(0, 40, 300) / 40, "b": rng.random(300)}
    bad, weight = x["a"] > 0.8, rng.integers(1, 9, 300)
    weight[0] = 2_000_000_000  # a hot row keeps its weight and hides no other
    rules = Q.learn_rules(x, bad, weight)
    out = np.zeros(300, bool)
    for r in rules:
        out |= Q._covered(r, x)
    assert (out == bad).all()
    assert Q.learn_rules(x, bad, np.zeros(300, dtype=np.int64)) == []


def test_a_hot_document_is_one_row_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "learn_rules", lambda x, bad, weight: seen.append((len(bad), int(weight.sum()))) or [])
    names = ["n_words", "word_chars"]
    texts = [(1, 100, 400)] * 3 + [(k, 100 + k, 400) for k in range(2, 52)] + [(None, 90, 300), (99, 10, 30)]
    counted = spark.createDataFrame(texts, "doc_id long, n_words long, word_chars long")
    counted = counted.select("*", *(F.lit(0).cast("long").alias(c) for c in Q.COUNTS if c not in names))
    labels = spark.createDataFrame([(1, 0)] * 500 + [(1, None), (None, 1), (99, 1)] + [(k, 1) for k in range(2, 52)], "doc_id long, quality int")
    Q.fit(counted, labels)
    Q.fit(counted, labels, max_labels=25)
    assert seen[0] == (51, 1550)  # 3 rows of 500 labels, and 50 documents
    assert 0 < seen[1][0] < 45


def test_the_list_becomes_an_ordered_conditional(spark):
    rules = [[Q.Condition("n_words", True, 10.0), Q.Condition("mean_word", False, 3.0)], [Q.Condition("n_words", False, 4.0)]]
    rows = spark.createDataFrame([(12, 24), (12, 60), (3, 9), (5, 20)], "n_words long, word_chars long")
    rows = rows.select("*", *(F.lit(0).alias(c) for c in Q.COUNTS if c not in rows.columns))
    got = rows.select("n_words", "word_chars", Q.rules_column(rules, Q.feature_columns()).alias("rule")).collect()
    assert [r.rule for r in got] == [1, 0, 2, 0]
    assert Q.describe(rules)[0] == "n_words >= 10 and mean_word <= 3 -> drop"


def test_report_on_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_report(spark, docs, labels).join(labels, "doc_id").collect()
    passed = [r for r in got if not r.base_failed]
    assert all(not r.kept for r in got if r.base_failed)
    assert np.mean([r.kept == bool(r.quality) for r in passed]) > 0.97
    assert np.mean([r.kept for r in passed if r.quality]) > 0.98
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_edge_rows(spark, docs, no_docs, doc_rows):
    labels = spark.createDataFrame([(1, 1, 5), (2, 0, 5), (2, 0, 5), (None, 0, 5), (3, None, 5), (999, 0, 5)], "doc_id long, quality int, n_words int")
    got = Q.quality_report(spark, docs, labels).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(d[0]), brute_counts(d[1])[0]) for d in doc_rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept is not r.base_failed for r in Q.quality_report(spark, docs, none).collect())
    assert Q.quality_report(spark, no_docs, labels).count() == 0
