import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tabsmith.llm import digest_merge as M


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        seen = False
        for i in ids:
            first = i == keep and not seen
            seen |= first
            out[i, keep, len(ids), first, sha] += 1
    return out


@pytest.mark.parametrize("fan_in, parts", [(2, 1), (2, 7), (16, 3), (3, 20)])
def test_report_equals_brute_force(spark, docs, doc_rows, fan_in, parts):
    found = M.duplicate_report(spark, docs.repartition(parts), fan_in)
    assert Counter(map(tuple, found.collect())) == brute([r[:2] for r in doc_rows])
    assert dict(found.dtypes) == {
        "doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"
    }


def test_white_space_is_one_space_but_stays_at_the_ends(spark):
    rows = [(1, "a \t\n b"), (2, "a b"), (3, " a b"), (4, "a\x0bb\r\n"), (5, "a b "), (6, "a b"), (7, "A b")]
    found = {r.doc_id: r.keep_id for r in M.duplicate_report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_a_hot_text_over_many_runs(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"text {k}") for k in range(3000, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(37)
    found = M.duplicate_report(spark, df).collect()
    assert Counter(map(tuple, found)) == brute(rows)


def test_text_ids_and_all_columns_stay(spark, docs, doc_rows):
    named = docs.selectExpr("cast(doc_id as string) as doc_id", "text", "lang as run", "source as `a.b`", "n_chars as digest", "n_hit as least")
    kept = M.drop_exact_copies(spark, named.repartition(5))
    assert kept.columns == named.columns
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in doc_rows}
    assert kept.count() == len(norm)


def test_empty_table(spark, no_docs):
    assert M.duplicate_report(spark, no_docs).collect() == []
    assert M.drop_exact_copies(spark, no_docs).collect() == []
