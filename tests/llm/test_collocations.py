import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabsmith.llm import collocations as C
from tabsmith.llm.word_index import WordIndex, number_words, plain_bytes

LOWER = {chr(c): chr(c + 32) for c in range(65, 91)}


def pieces(text):
    text = "".join(LOWER.get(c, c) for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", text) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        for words in pieces(text):
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = {p[i:j] for p, a in many.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * counts[p[i:j]]}
        found = []
        for p, a in many.items():
            if p not in held:
                score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n, score))
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out |= {(r[0], i, *r[1:]) for i, r in enumerate(found[:top], 1)}
    return out


def made(n, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "ß", "日本", "x y", "a", "a", "a", *[f"w{k}" for k in range(30)]]
    out = []
    for k in range(n):
        words = rnd.choices(vocabulary, k=rnd.randrange(40))
        if k % 3 == 0:
            words[5:5] = "state of the new york city hall".split()
        gaps = rnd.choices([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! "], weights=[12, 1, 1, 1, 1, 1, 1, 1], k=len(words))
        out.append(("".join(w + g for w, g in zip(words, gaps)), rnd.choice(["en", "en", "de", None])))
    return [*out, (None, "en"), ("", None), ("a " * 2000, "hot"), (".,;:!?", "fr"), ("퟿ word", "fr")]


@pytest.mark.parametrize("shard_bytes, least, top", [(1, 4, 50), (2_000, 4, 2000), (10**7, 7, 7)])
def test_report_equals_brute_force(spark, shard_bytes, least, top):
    rows = made(120)
    df = spark.createDataFrame([(i, t, g, g, 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, word string, f int")
    found = C.collocation_report(spark, df.repartition(3), least=least, top=top, shard_bytes=shard_bytes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == brute(rows, least, top)


def test_block_sums_do_not_depend_on_their_number(spark, monkeypatch):
    rows = made(60, 5)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(C, "BLOCK", 50)
    found = {tuple(r) for r in C.collocation_report(spark, df.repartition(4), least=3, shard_bytes=500).collect()}
    assert found == brute(rows, 3, 2000) and found


def test_nothing_frequent_and_no_rows(spark, docs, doc_rows, no_docs):
    assert C.collocation_report(spark, docs.where("doc_id <> 13")).collect() == []
    assert C.collocation_report(spark, no_docs).collect() == []
    found = {tuple(r) for r in C.collocation_report(spark, docs).collect()}
    assert found == brute([(r[1], r[2]) for r in doc_rows], 100, 2000) and len(found) == 4


@pytest.mark.parametrize("seed", range(4))
def test_index_extension_equals_counting(seed):
    rnd = np.random.default_rng(seed)
    seq = rnd.integers(0, 6, 300)
    index = WordIndex(seq, 6, 5)
    found = index.words()
    for n in range(2, 6):
        found = index.extend(*found, right=bool(rnd.integers(2)))
        windows = Counter(tuple(seq[i : i + n].tolist()) for i in range(len(seq) - n + 1))
        want = {w: c for w, c in windows.items() if 0 not in w}
        assert {tuple(p): c for p, c in zip(found[0].tolist(), found[2].tolist())} == want
        for half, order in ((0, 1), (1, -1)):  # the intervals are right in either direction
            text = np.concatenate([seq, [0]])[::order]
            rows = sorted(range(len(text)), key=lambda p: [text[(p + k) % len(text)] for k in range(5)])
            for p, low, c in zip(found[0].tolist(), found[1][half].tolist(), found[2].tolist()):
                assert all([int(text[(rows[r] + k) % len(text)]) for k in range(n)] == p[::order] for r in range(low, low + c))


def test_words_are_numbered_by_frequency():
    words, counts, seq = number_words(plain_bytes("B b. c b\td\n\nÉ,c é"))
    assert words[0] == "b" and dict(zip(words, counts.tolist())) == {"b": 3, "c": 2, "d": 1, "É": 1, "é": 1}
    spelled = [words[k - 1] if k else "|" for k in seq.tolist()]
    assert " ".join(spelled) == "b b | c b d | É | c é |"
    assert [x.tolist() if not isinstance(x, list) else x for x in number_words(b" \n ")] == [[], [], []]


def test_a_word_longer_than_a_step():
    long = "x" * 3_000_000
    words, counts, _ = number_words(plain_bytes(f"{long} y {long} {long}z"))
    assert sorted(zip(map(len, words), counts.tolist())) == [(1, 1), (3_000_000, 2), (3_000_001, 1)]
