from collections import Counter, defaultdict

import numpy as np
import pytest

from tabsmith.llm import bagminhash as B
from tabsmith.llm.components import components
from tabsmith.llm.shingles import pack, shingles, weighted_jaccard


def bag(text, width=5):
    w = text.lower().encode().split()
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def brute_classes(rows, threshold=0.8):
    """{doc_id: least doc_id of its class} by comparing all pairs."""
    texts = sorted({t for _, t in rows if t is not None})
    bags = [bag(t) for t in texts]
    inverted = defaultdict(list)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, b in enumerate(bags):
        for j in {j for s in b for j in inverted[s]}:
            if similarity(b, bags[j]) >= threshold:
                parent[root(i)] = root(j)
        for s in b:
            inverted[s].append(i)
    at = {t: root(i) for i, t in enumerate(texts)}
    key = [(d, ("null", d) if t is None else at[t]) for d, t in rows]
    least = {}
    for d, k in key:
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return sorted(((d, least.get(k)) for d, k in key), key=str)


def test_packed_similarity_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = " ".join(rng.choice(list("abcdef"), rng.integers(0, 60)))
        b = " ".join(rng.choice(list("abcdef"), rng.integers(0, 60)))
        e, c, at = shingles([a, b], 2)
        got = weighted_jaccard(*(pack(e[at[i] : at[i + 1]], c[at[i] : at[i + 1]]) for i in (0, 1)))
        assert got == pytest.approx(similarity(bag(a, 2), bag(b, 2)))


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(5)
    errors = []
    for t in range(150):
        words = [f"w{t}x{i}" for i in range(rng.integers(20, 150))]
        a = " ".join(np.repeat(words, rng.integers(1, 7, len(words))))
        b = " ".join(np.repeat(words[: int(len(words) * 0.8)] + ["z"], rng.integers(1, 7, int(len(words) * 0.8) + 1)))
        s = B.signatures([a, b], 256)
        errors.append((s[0] == s[1]).mean() - similarity(bag(a), bag(b)))
    assert abs(np.mean(errors)) < 4 * np.std(errors) / np.sqrt(len(errors))
    assert np.isinf(B.signatures(["", " \n"])).all()


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = sorted(((r.doc_id, r.class_id) for r in B.near_duplicate_report(spark, docs).collect()), key=str)
    assert got == want
    kept = B.keep_one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c in want})


def test_chain_and_group_of_variants(spark):
    base = [f"v{i}" for i in range(300)]
    rows = []
    for k in range(40):  # each differs from the last in a few words: a chain of links
        rows.append((k, " ".join(base)))
        base = base[:]
        base[k * 7] = f"new{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in B.near_duplicate_report(spark, docs).select("doc_id", "class_id").collect()), key=str)
    assert got == brute_classes(rows)


def test_edge_rows(spark, docs, doc_rows, no_docs):
    rows = [(r[0], r[1]) for r in doc_rows]
    got = sorted(((r.doc_id, r.class_id) for r in B.near_duplicate_report(spark, docs).collect()), key=str)
    assert got == brute_classes(rows)
    kept = B.keep_one_of_each(spark, docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(map(str, ids)) == sorted(["1", "4", "5", "6", "9", "10", "11", "12", "13", "None", "None"])
    assert B.near_duplicate_report(spark, no_docs).count() == 0 and B.keep_one_of_each(spark, no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (500, 500)], "a long, b long")
    comps = {r.node: r.comp for r in components(spark, links).collect()}
    assert comps == {**dict.fromkeys(range(101), 0), 400: 400, 500: 400}


def test_group_of_variants_near_the_threshold(spark, monkeypatch):
    """Most pairs are just under the similarity wanted: probes meet members in many small blocks."""
    monkeypatch.setattr(B, "BLOCK", 7)
    monkeypatch.setattr(B, "PROBES", 5)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for k in range(90):
        words = base[:]
        for i in rng.choice(len(words), rng.integers(2, 5), replace=False):
            words[i] = f"n{k}x{i}"
        rows.append((k, " ".join(words * (2 if k % 9 == 0 else 1))))  # some twice over: a multiset of its own
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in B.near_duplicate_report(spark, docs).select("doc_id", "class_id").collect()), key=str)
    want = brute_classes(rows)
    assert got == want and 2 < len({c for _, c in want}) < 80


@pytest.mark.parametrize("a, b", [(70_000, 90_000), (65_535, 65_536), (200_000, 200_001), (3, 150_000)])
def test_counts_beyond_sixteen_bits_are_exact(a, b):
    packed = []
    for n in (a, b):
        element, count, _ = shingles(["w " * (n + 4) + "one two three four five six"])
        packed.append(pack(element, count))
    both = []
    for n in (a, b):
        words = ["w"] * (n + 4) + "one two three four five six".split()
        both.append(Counter(zip(*(words[k:] for k in range(5)))))
    want = sum((both[0] & both[1]).values()) / sum((both[0] | both[1]).values())
    assert weighted_jaccard(*packed) == pytest.approx(want, abs=1e-12)
    (x, n), (y, m) = B._units(packed[0]), B._units(packed[1])
    common = len(np.intersect1d(x, y))
    assert common / (n + m - common) == pytest.approx(want, abs=1e-12)
