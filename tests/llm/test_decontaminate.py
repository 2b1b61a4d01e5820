import hashlib
import re

import pytest

from tabsmith.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(doc_id, text, items, width=13):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        size = min(width, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return (doc_id, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words))


@pytest.fixture()
def case(spark):
    passage = " ".join(f"Q{i}" for i in range(20))
    items = [(1, passage), (10, "Solo-Wort"), (2, passage), (2, passage), (3, None), (4, " ?! "), (None, "né à Paris"), (5, "x " * 30)]
    docs = [
        (1, "before " * 4 + passage.lower() + " after"),
        (2, "clean text of ten words or so, nothing here at all"),
        (3, " ".join(f"Q{i}" for i in range(12))),
        (4, None),
        (5, ""),
        (6, "SOLO.wort," * 3 + "né À paris | né à PARIS"),
        (7, "x " * 12),
        (8, "x " * 40 + "filler " * 900),
        (9, passage + " | " + passage),
        (9, passage + " | " + passage),
        (None, "word " * 20_000 + passage),
        (11, "Q12 Q13 Q14 Q15 Q16 Q17 Q18 Q19 Q0 Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q8 Q9 Q10 Q11 Q12"),
    ]
    return docs, items


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 40])
def test_report_equals_brute_force(spark, case, block_bytes):
    docs, items = case
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, hit string, items int")
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, n_words string")
    got = [tuple(r) for r in D.contamination_report(spark, df, bench, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == sorted((brute(*d, items) for d in docs), key=str)
    kept = D.remove_contaminated(spark, df, bench, block_bytes=block_bytes)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in got if not r[5])


def test_empty_tables(spark, case):
    docs, items = case
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination_report(spark, none, bench).count() == 0
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.contamination_report(spark, df, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(docs) and not any(r.contaminated or r.n_hit for r in got)


def test_spans_are_cut(spark, case):
    docs, items = case
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.remove_spans(spark, df, bench).collect()}
    assert got[1].text == "before " * 4 + " after" and got[1].n_chars == len(got[1].text)
    assert got[2].text == docs[1][1] and got[2].n_chars == 7 and got[4].text is None
    again = D.contamination_report(spark, df.sparkSession.createDataFrame([(1, got[9].text)], "doc_id long, text string"), bench).first()
    assert again.n_hit == 0
