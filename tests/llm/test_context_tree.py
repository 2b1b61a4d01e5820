import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import context_tree as C


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def brute(rows, depth):
    """Unigram and context-tree scores of rows (doc_id, text), straight from the definitions."""
    words = lambda t: [w for w in (t or "").encode().lower().split()] + [None]
    train = [t or "" for d, t in rows if not fold(d)]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    seq = lambda t: b"\xff" * depth + t.encode() + b"\xff"
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    for t in train:
        s = seq(t)
        for i in range(depth, len(s)):
            for k in range(8):
                j = 1 << k | s[i] >> 8 - k
                for d in range(depth + 1):
                    counts[d][s[i - d : i], j][s[i] >> 7 - k & 1] += 1
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    log_w = [{} for _ in range(depth + 1)]
    below = [defaultdict(float) for _ in range(depth + 1)]
    for d in range(depth, -1, -1):
        for (ctx, j), (a, b) in counts[d].items():
            e = kt(a, b)
            x = below[d][ctx, j]
            log_w[d][ctx, j] = e if d == depth else math.log(0.5) + max(e, x) + math.log1p(math.exp(-abs(e - x)))
            if d:
                below[d - 1][ctx[1:], j] += log_w[d][ctx, j]

    def p_one(s, i, j, d=0):
        key = (s[i - d : i], j)
        if key not in counts[d]:
            return 0.5
        a, b = counts[d][key]
        one = (b + 0.5) / (a + b + 1)
        if d == depth:
            return one
        stay = 1 / (1 + math.exp(below[d][key] - kt(a, b)))
        return stay * one + (1 - stay) * p_one(s, i, j, d + 1)

    out = []
    for doc, t in rows:
        s, total = seq(t or ""), 0.0
        for i in range(depth, len(s)):
            for k in range(8):
                p = p_one(s, i, 1 << k | s[i] >> 8 - k)
                total += math.log10(p if s[i] >> 7 - k & 1 else 1 - p)
        w = words(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((doc, fold(doc), len(w), sum(c[x] > 0 for x in w), n, base, total))
    return out


def check(spark, rows, depth, top):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, score int")
    got = C.score_texts(spark, docs, C.crc_fold(F.col("doc_id"), 5) == 1, depth, top).drop("bits_per_byte").collect()
    got, want = (sorted(map(tuple, x), key=lambda r: (str(r[0]), r[2], round(r[6], 6))) for x in (got, brute(rows, depth)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("depth, top", [(3, 500_000), (2, 7), (4, 0)])
def test_scores_equal_brute_force(spark, depth, top):
    rng = np.random.default_rng(depth)
    words = ["the", "of", "Straße", "été", "x", "THE", "日本", "a\x00b"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(25)]
    rows += [(3, rows[3][1]), (None, "nul id"), (30, None), (31, ""), (32, " \n"), (33, "never seen before")]
    check(spark, rows, depth, top)


def test_a_long_word_leaves_the_other_words_of_its_batch_alone(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 200)  # the long words share a chunk with some of the texts only
    rows = [(i, "the of the x") for i in range(40)] + [(40, "the of " + "y" * 300 + " x"), (41, "x " + "z" * 256 + " the"), (42, "z" * 257 + " of")]
    check(spark, rows, 2, 500_000)
    check(spark, rows, 2, 0)


def test_ids_keep_their_type(spark):
    rows = [("doc-a", "one two"), ("07", "two three"), (None, "three")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = C.score_report(spark, docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["07", "None", "doc-a"]
    assert {r.doc_id: r.held_out for r in got} == {d: fold(d) for d, _ in rows}
    assert C.score_report(spark, spark.createDataFrame([(5, "x")], "doc_id int, text string")).schema["doc_id"].dataType.simpleString() == "int"


def test_no_rows_and_no_training_rows(spark):
    held = [i for i in range(60) if fold(i)]
    check(spark, [(i, "only held out") for i in held], 2, 500_000)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.score_report(spark, empty).count() == 0


def test_probabilities_of_all_next_bytes_add_up(spark):
    texts = ["abra cadabra", "abracadabra", "bar"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = C.count_keys(spark, docs, F.lit(True), 2).where("kind = 1").select("key", "n_train", "n_all")
    ctx = int.from_bytes(b"ra", "big") << 8
    extra = spark.createDataFrame([(ctx | b, 0, 1) for b in range(256)], "key long, n_train long, n_all long")
    runs = counts.union(extra).groupBy("key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))
    got = C.run_probabilities(spark, runs, 2).where(f"key >= {ctx} and key < {ctx + 256}").collect()
    assert len(got) == 256 and sum(10**r.log10_p for r in got) == pytest.approx(1)


def test_held_out_text_is_compressed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = C.score_report(spark, docs).where("held_out").agg(F.avg("bits_per_byte").alias("bits")).first()
    assert got.bits < 2.4
