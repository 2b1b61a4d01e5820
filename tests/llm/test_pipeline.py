import __spark_entry__ as entry
import pytest

import corpus_pipeline as P
from tabsmith.llm import langid, secrets, spm_tokens
from tabsmith.llm.common import read_table
from test_bagminhash import brute_classes
from test_decontaminate import brute as brute_hits
from test_secrets import base_spans, brute as brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "secret_scan", "sentencepiece"]
    named = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in named} and "pipeline" in named
    assert "pipeline" not in entry.oracle_sql()


def test_run_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    pred = {r.doc_id: r.lang_pred for r in langid.language_report(spark, docs).collect()}
    left = sorted(d for d in rows if pred[d] != "und")
    assert left == sorted(d for d in rows if any(c.isalpha() for c in rows[d].text or ""))  # clean documents stay
    left = sorted({c for _, c in brute_classes([(d, rows[d].text) for d in left])})
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    left = [d for d in left if not brute_hits(d, rows[d].text, items)[5]]
    spans = {r[0]: r[5] for r in brute_secrets([(d, rows[d].text, rows[d].source) for d in left])}
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert sorted(got) == left
    peer = spm_tokens.Codec(open(spm_tokens.DEFAULT_MODEL, "rb").read()).peer
    for d in left:
        text, at, out = rows[d].text, 0, ""
        for s in filter(None, spans[d].split(",")):
            a, b = map(int, s.split(":")[1:])
            out, at = (out + text[at:a] + secrets.MASK if a >= at else out), max(at, b)
        out += text[at:]
        r = got[d]
        assert r.text == out and not base_spans(out) and r.token_parity
        assert (r.lang, r.source) == (rows[d].lang, rows[d].source) and r.n_chars == len(out)
        assert r.token_ids == peer.encode(out) and r.n_tokens == len(r.token_ids)


@pytest.mark.parametrize("k", range(5))
def test_each_stage_takes_rows_with_nulls_and_no_rows(spark, docs, no_docs, k):
    name, stage = P.STAGES[k]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs, no_docs):
        out = stage(spark, table.select(columns), SF)
        assert out.columns[:5] == columns and out.count() <= table.count()
        assert k == 4 or out.columns == columns
