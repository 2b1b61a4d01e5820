import numpy as np
from pyspark.sql import functions as F

from tabsmith.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_hashes_follow_letters_only():
    a, bounds, has = L.ngrams(["Straße--12 été", "straße ÉTÉ", "", "1 2 3", "x"])
    part = [a[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    assert part[0] == part[1] and len(part[0]) > 5
    assert part[2] == part[3] == [] and len(part[4]) > 0
    assert has.tolist() == [True, True, False, False, True]
    one, b1, _ = L.ngrams(["x"])
    assert one.tolist() == part[4] and b1.tolist() == [0, len(one)]


def test_lookup_returns_all_languages_of_an_ngram_and_few_others():
    rng = np.random.default_rng(2)
    masks = np.zeros(L.SLOTS, dtype=np.uint64)
    member = {b: rng.integers(0, 2**32, 100_000, dtype=np.uint32) for b in range(3)}
    member[1][:500] = member[0][:500]
    for b, h in member.items():
        for k in range(L.HASHES):
            np.bitwise_or.at(masks, L.slots_of(h, k), np.uint64(1 << b))
    f = L.LanguageFilter(["a", "b", "c"], masks)
    for b, h in member.items():
        assert ((f.lookup(h) >> b) & 1).all()  # no false negative
    other = rng.integers(0, 2**32, 200_000, dtype=np.uint32)
    for b in range(3):
        rate = ((f.lookup(other) >> b) & 1).mean()
        assert abs(rate - f.false_rate[b]) < 0.002


def test_held_out_accuracy_and_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.language_report(spark, docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok"), F.count("*").alias("n")).first()
    assert held.n > 200 and held.ok > 0.99
    assert got.where("score < 0 or score > 1 or lang_pred = 'und'").count() == 0
    # labels of held-out rows, sources and ids are no inputs
    other = docs.withColumn("lang", F.when(L.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    same = L.language_report(spark, other)
    assert same.exceptAll(got.drop("lang")).count() == 0


def test_edge_rows(spark, docs, no_docs, doc_rows):
    got = L.language_report(spark, docs).collect()
    assert len(got) == len(doc_rows)
    for r in got:
        text = next(t for t in doc_rows if t[0] == r.doc_id)[1]
        if r.doc_id in (4, 5, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0), (r, text)
        assert 0 <= r.score <= 1
    kept = L.keep_known_languages(spark, docs)
    assert kept.columns == docs.columns and not {4, 5, 10} & {r.doc_id for r in kept.collect()}
    assert L.language_report(spark, no_docs).count() == 0 and L.keep_known_languages(spark, no_docs).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.language_report(spark, unlabelled).collect()} == {"und"}


def test_tie_goes_to_the_first_name():
    f = L.LanguageFilter(["de", "en"], np.full(L.SLOTS, 3, dtype=np.uint64) * (np.arange(L.SLOTS, dtype=np.uint64) % np.uint64(2)))
    pred, _ = f.predict(["anything at all"])
    assert pred == ["de"]


def test_languages_of_rare_ngrams_are_told_and_unseen_letters_kept(spark):
    rng = np.random.default_rng(5)

    def rows(lang, first, start):  # 300,000 characters of 2,000 letters: nearly every 4-gram is seen once, below 1e-5 of all
        return [(start + i, "".join(map(chr, first + rng.integers(0, 2000, 500))), lang, "s") for i in range(600)]

    data = rows("zh", 0x4E00, 0) + rows("ko", 0xAC00, 1000) + [(5000, "αβγ ωψ", None, "s"), (5001, "12 3", None, "s"), (5002, chr(0x4E05), None, "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in L.language_report(spark, docs).collect()}
    assert all(got[d].lang_pred == lang and got[d].score > 0.5 for d, _, lang, _ in data if lang)
    assert got[5002].lang_pred == "zh" and got[5002].score > 0
    # letters without a known n-gram: the language learned from most text, without a score
    assert got[5000].score == 0.0
    assert got[5000].lang_pred in ("zh", "ko") and (got[5001].lang_pred, got[5001].score) == ("und", 0.0)
    kept = {r.doc_id for r in L.keep_known_languages(spark, docs).collect()}
    assert kept == {r[0] for r in data} - {5001}


def test_more_languages_than_bits_of_a_word(spark):
    data = [(10 * i + j, "".join(map(chr, range(0x4E00 + 20 * i, 0x4E00 + 20 * i + 20))), f"l{i:03}", "s") for i in range(140) for j in range(10)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = L.language_report(spark, docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang and score > 0.9").count() == len(data)


def test_rarest_ngrams_go_first_when_the_slots_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_GRAMS", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.learn(docs.where(~L.held_out()))
    rows = docs.where(L.held_out()).select("text", "lang").collect()
    pred, score = model.predict([r.text for r in rows])
    assert np.mean([p == r.lang for p, r in zip(pred, rows, strict=True)]) > 0.97 and min(score) > 0


def test_letters_without_a_known_ngram_are_of_the_commonest_language(spark):
    rows = [(k, "plain english words " * 3, "en", "s") for k in range(20)] + [(k, "deutsche Wörter", "de", "s") for k in range(20, 30)]
    df = spark.createDataFrame(rows + [(50, "αβγ", None, "s"), (51, "", None, "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.language_report(spark, df).collect()}
    assert got[50] == ("en", 0.0) and got[51] == ("und", 0.0)


def test_prediction_equals_exact_sets(spark):
    """The filter's decision against sets of n-grams without hashing into slots: places voted by their longest known n-gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    model = L.learn(docs)
    rows = docs.select("text", "lang").where("lang is not null").collect()
    counts = {}
    for r in rows:
        for order in L._places([r.text or ""])[0]:
            for h in order[order != 0].tolist():
                counts.setdefault(h, {}).setdefault(r.lang, 0)
                counts[h][r.lang] += 1
    total = {}
    for held in counts.values():
        for lang, n in held.items():
            total[lang] = total.get(lang, 0) + n
    member = {}
    for h, held in counts.items():
        share = {lang: n / total[lang] for lang, n in held.items()}
        member[h] = {lang for lang, x in share.items() if x * L.MAX_RATIO >= max(share.values())}
    same = 0
    for r in rows:
        hashes, bounds, _ = L._places([r.text or ""])
        votes = dict.fromkeys(sorted(total), 0)
        for place in zip(*(h.tolist() for h in hashes)):
            for lang in next((member[h] for h in place if h and h in member), ()):
                votes[lang] += 1
        want = max(sorted(votes), key=lambda lang: votes[lang])
        same += model.predict([r.text or ""])[0][0] == want
    assert same >= 0.995 * len(rows)
