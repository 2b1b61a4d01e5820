"""Strings, JSON, transcripts (FX-C1, FX-C2) and TF-IDF on small inputs."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsmith.functions import exprs as fx
from tabsmith.functions.aliases import candidate_name
from tabsmith.operators import term_counts as tc
from tabsmith.operators import text as tx
from tabsmith.operators import transcripts as tr


def test_strip_and_truncate(spark):
    log = "/usr/lib/x.py:12: UserWarning: careful\n  warnings.warn(x)\nresult 1\n"
    df = spark.createDataFrame([(log, "x" * 5000)], "log string, big string")
    r = df.select(fx.strip_warnings("log").alias("a"), fx.truncate_tail("big", 120).alias("b")).first()
    assert r["a"] == "result 1"
    assert r["b"].startswith("[...4960 chars truncated...]\n") and r["b"].endswith("x" * 40) and len(r["b"].split("\n")[1]) == 40


def test_tool_calls_and_text(spark):
    resp = {
        "output_text": "",
        "output": [
            {"type": "function_call", "call_id": "c1", "name": "read_file", "arguments": json.dumps({"path": "a.csv"})},
            {"type": "function_call", "call_id": "c2", "name": "list_files", "arguments": ""},
            {"type": "message", "content": [{"type": "output_text", "text": "hello"}, {"type": "refusal", "text": "no"}]},
            {"type": "message", "content": [{"type": "output_text", "text": " world "}]},
        ],
    }
    df = spark.createDataFrame([(1, json.dumps(resp)), (2, json.dumps({"output_text": "direct", "output": []}))], "rid int, response string")
    calls = {r["call_id"]: r for r in tr.extract_tool_calls(df, "response", ["rid"]).collect()}
    assert calls["c1"]["arguments"] == {"path": "a.csv"} and calls["c2"]["arguments"] == {}
    texts = {r["rid"]: r["t"] for r in df.select("rid", tr.extract_text("response").alias("t")).collect()}
    assert texts == {1: "hello\n world", 2: "direct"}


def test_aliases():
    assert candidate_name("logreg") == "logistic_regression"
    assert candidate_name({"model_type": "xgboost"}) == "xgboost_classifier"
    assert candidate_name("xgboost", "regression") == "xgboost_regressor"  # D8
    assert candidate_name("my_model") == "my_model"
    import pytest

    with pytest.raises(ValueError):
        candidate_name({})
    with pytest.raises(ValueError):
        candidate_name(3)


def test_tfidf_small(spark):
    docs = spark.createDataFrame([(1, "Ça va, ça va bien"), (2, "bien sûr")], "id int, text string")
    voc = {r["term"]: r for r in tx.tfidf_vocabulary(docs, "id", "text").collect()}
    assert voc["ça"]["corpus_tf"] == 2 and voc["ça va"]["corpus_tf"] == 2 and "sûr" in voc
    w = tx.tfidf_weights(docs, "id", "text", tx.tfidf_vocabulary(docs, "id", "text"))
    norms = w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in norms)


def test_bounded_read_rules(spark):
    df = spark.createDataFrame([("a.csv", 60_000, "x"), ("b.txt", 60_000, "y" * 300), ("c.txt", 300_000, "z")], "name string, size long, text string")
    got = {r["name"]: (r["status"], r["content"]) for r in tx.bounded_read(df, "name", "size", "text", max_chars=100).collect()}
    assert got["a.csv"][0] == "refused" and got["c.txt"][0] == "refused"
    assert got["b.txt"][0] == "ok" and got["b.txt"][1].startswith("[...180 chars truncated...]")  # limit clamps to 200


def test_tool_call_arguments_as_object(spark):
    resp = {"output": [{"type": "function_call", "call_id": "c9", "name": "inspect_csv", "arguments": {"path": "train.csv", "max_rows": 3}}]}
    df = spark.createDataFrame([(1, json.dumps(resp))], "rid int, response string")
    r = tr.extract_tool_calls(df, "response", ["rid"]).first()
    assert r["call_id"] == "c9" and r["arguments"] == {"path": "train.csv", "max_rows": "3"}


def _term_brute(docs):
    tf, df = Counter(), Counter()
    for _, text in docs:
        toks = re.findall(r"\w{2,}", (text or "").lower())
        got = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
        tf.update(got)
        df.update(set(got))
    return {t: (tf[t], df[t]) for t in tf}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_frequent_terms_in_two_passes_equal_all_terms(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)] + ["É1", "ß_", "x"]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 30, 203])]) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(7, None), (None, "w1 w2"), (8, "")]
    monkeypatch.setattr(tc, "CHUNK_BYTES", 500)  # many chunks a task
    docs, want = _frame(spark, rows), _term_brute(rows)
    every = {r.term: (r.corpus_tf, r.doc_freq) for r in tx.term_statistics(docs, "text").collect()}
    assert every == want
    top = sorted(want, key=lambda t: (-want[t][0], t))[:40]
    some = tx.term_statistics(docs, "text", 40)
    got = {r.term: (r.corpus_tf, r.doc_freq) for r in some.collect()}
    assert {t: got[t] for t in top} == {t: want[t] for t in top}
    least = sorted((want[t][0] for t in want if " " not in t), reverse=True)[39]
    assert all(" " not in t or n >= 2 for t, (n, _) in got.items()) and len(got) < len(want)  # the bound rules terms out before the shuffle
    assert not [t for t in want if want[t][0] >= least and t not in got]
    voc = tx.tfidf_vocabulary(docs, "doc_id", "text", 40)
    assert [r.term for r in voc.orderBy("term_index").collect()] == sorted(top)
    assert "Generate" not in voc._jdf.queryExecution().executedPlan().toString()  # no row per occurrence of a term


def test_weights_of_repeated_and_missing_keys(spark):
    rows = [(1, "red fox red"), (2, "fox den"), (1, "red fox"), (None, "red red"), (3, None), (4, "zz")]
    docs = _frame(spark, rows * 3)
    voc = spark.createDataFrame([("red", 1.5, 2), ("fox", 2.0, 0), ("red fox", 3.0, 1)], "term string, idf double, term_index int")
    got = {(r.doc_id, r.term): (r.term_index, r.weight) for r in tx.tfidf_weights(docs, "doc_id", "text", voc).collect()}
    raw = {1: {"red": (2, 9 * 1.5), "fox": (0, 6 * 2.0), "red fox": (1, 6 * 3.0)}, 2: {"fox": (0, 3 * 2.0)}}
    want = {(k, t): (i, w / math.sqrt(sum(x * x for _, x in d.values()))) for k, d in raw.items() for t, (i, w) in d.items()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_text_vectors_of_the_model_come_from_counts_in_tasks(spark):
    from pyspark.ml.functions import vector_to_array

    from tabsmith.plans import models as md

    docs = _frame(spark, [(1, "red fox red"), (2, "fox den"), (3, None), (4, "Red fox")])
    vectors = md.fit_text(docs, "text", 3)  # fox 3, red 3, red fox 2
    out = vectors(docs)
    got = {r.doc_id: r.v for r in out.select("doc_id", vector_to_array("features").alias("v")).collect()}
    idf = [math.log(5 / (df + 1)) + 1 for df in (3, 2, 2)]
    for doc, tf in {1: (1, 2, 1), 2: (1, 0, 0), 3: (0, 0, 0), 4: (1, 1, 1)}.items():
        w = [a * b for a, b in zip(tf, idf)]
        norm = math.sqrt(sum(x * x for x in w)) or 1.0
        assert got[doc] == pytest.approx([x / norm for x in w])
    with pytest.raises(ValueError):  # ties go by term, and a corpus without terms is named as the fault
        md.fit_text(_frame(spark, [(1, "a b"), (2, None)]), "text")
