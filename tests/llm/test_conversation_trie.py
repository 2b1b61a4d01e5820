import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabsmith.llm import conversation_trie as T
from tabsmith.llm.double_array import DoubleArrayTrie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in sorted(turns.items()):
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        kids = [below[k] for k in children[p]]
        below[p] = (sum(k[0] for k in kids) or 1, sum(k[1] for k in kids) + (len(members[p]) - 1) * words)
    return Counter(
        (
            m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *below[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def made(n, seed=1):
    rnd = random.Random(seed)
    texts = ["hi", "hi there you", "", None, "a b\tc\x0bd", "ß 日本"]
    rows = []
    for _ in range(n):
        c = rnd.randrange(n)
        start = rnd.choice([[], ["hi there you", "sure"], ["hi there you", "sure", "more words here", "a", "b", "c"]])
        body = start + rnd.choices(texts, k=rnd.randrange(5))
        rows += [(c, rnd.choice([k, k, None]), rnd.choice(["user", "user", None]) if k > 6 else "user", t) for k, t in enumerate(body)]
    return rows


def report(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, T.trie_report(spark, df, **kw).collect()))


@pytest.mark.parametrize("unit_rows, shard_rows", [(1, 3), (5, 20), (1000, 4000)])
def test_nodes_equal_brute_force(spark, unit_rows, shard_rows):
    rows = made(150)
    assert report(spark, rows, unit_rows=unit_rows, shard_rows=shard_rows) == brute(rows)


def test_long_and_hot_conversations_in_segments(spark, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 7)
    monkeypatch.setattr(T, "END_BLOCK", 10)
    hot = [(c, k, "user", f"turn {k}") for c in range(40, 100) for k in range(9)]
    long = [(7, k, "user", f"turn {k}") for k in range(300)]
    odd = [(None, 1, "user", "no conversation"), (-5, 0, "u", "x"), (-5, 0, "u", "x"), (10**12, None, None, None)]
    # one turn, its first: with a head of 1 to 3 turns of an absent conversation nothing is left
    alone = [(c, 0, "user", "only") for c in range(2001, 2019)]
    rows = hot + long + odd + alone
    found = report(spark, rows, unit_rows=10, shard_rows=40)
    assert found == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in found)


def test_empty_table_and_one_row(spark):
    assert not report(spark, [])
    assert not report(spark, [(None, 0, "user", "x")])
    assert report(spark, [(0, 0, "user", "x y")]) == brute([(0, 0, "user", "x y")])


@pytest.mark.parametrize("seed", range(3))
def test_double_array_finds_its_prefixes_only(seed):
    rnd = random.Random(seed)
    seqs = sorted({tuple(rnd.choices(range(9), k=rnd.randrange(1, 6))) for _ in range(200)})
    levels = []
    for d in range(5):
        live = [i for i, s in enumerate(seqs) if len(s) > d]
        levels.append(np.array([[seqs[i][d] for i in live], live], dtype=np.int64))
    trie = DoubleArrayTrie(levels)
    known = {s[:d] for s in seqs for d in range(6)}
    states = {}
    for p in known:
        state = np.zeros(1, dtype=np.int64)
        for x in p:
            state = trie.step(state, np.array([x]))
        states[p] = int(state[0])
    assert min(states.values()) == 0 and len(set(states.values())) == len(known)
    for p in known:
        for x in range(9):
            found = trie.step(np.array([states[p]]), np.array([x]))[0]
            assert (found >= 0) == ((*p, x) in known)
    assert all(trie.check[states[p]] == states[p[:-1]] for p in known if p)
