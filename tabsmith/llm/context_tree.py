"""Language-model scoring by context-tree weighting over bytes, with a unigram score beside it.

A byte is eight binary decisions, the nodes of a tree of bit prefixes.  Each node has a context tree over
the bytes before, up to ``DEPTH`` of them.  A context holds the counts of zeros and ones seen there; the
Krichevsky-Trofimov estimate of the counts is mixed half and half with the product of its longer
contexts' weighted probabilities, and so the weights of all depths come from the counts alone.
A decision's probability is the mix of the estimates along its path of contexts, by these weights;
a context never seen predicts one half.  Texts begin and end with the byte 0xFF, which UTF-8 never
has, so the probabilities of all texts add up.

As Spark jobs: one pass counts hashed words and byte runs of DEPTH + 1 bytes (by held-out side) and one
shuffle sums them.  The runs of a context of UNIT bytes go to one task, which builds the levels below it as
arrays; the levels above are grouped as tables, up to the root, and their mixes joined on the way back.
That gives the mixed probability of each run of bytes in the corpus.  A second pass over the texts adds up what a bounded
table of the most frequent words and runs gives (TOP of each, broadcast) and writes the rest of each text as pairs
of key and count; these meet the full tables in a shuffled join.  Keys beyond the table are rare by
construction, so no join key is hot.  The model is exact: no context and no word is dropped.

Words stand by 64-bit hashes.  Defined results: a null text is empty and has one token, the end; a null
doc_id counts as the empty text in the held-out rule; ids keep their type, whole numbers or texts; without training rows all counts are zero; every
row, repeated or not, is scored; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, cut, small_batches, text_chunks
from .shingles import word_hashes

DEPTH = 5
UNIT = 3
TOP = 1_000_000
BINS = 8  # bins a doubling, when the least count of the most frequent keys is sought
CHUNK = 400_000
FLUSH = 3_000_000
EDGE = 0xFF
WORD, RUN, END = 0, 1, 2
COUNT_SCHEMA = "kind int, key long, n_train long, n_all long"


def byte_runs(texts: list[str], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(runs, text): for every byte and the end of each text, the ``depth`` bytes before it and itself as a number."""
    pad = bytes([EDGE]) * depth
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"".join([pad + r + pad[:1] for r in raw]), dtype=np.uint8)
    sizes = np.array([len(r) for r in raw], dtype=np.int64) + 1
    text = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(len(text)) + (text + 1) * depth
    runs = np.zeros(max(len(buf) - depth, 0), dtype=np.int64)
    for k in range(depth + 1):
        runs <<= 8
        runs |= buf[k : k + len(runs)]
    return runs[at - depth], text


def _chunks(texts: list[str], depth: int) -> Iterator[list[str]]:
    most = 1 << (63 - 8 * (depth + 1))  # the text's number shares 63 bits with the run
    for part in text_chunks(texts, CHUNK):
        for k in range(0, len(part), most):
            yield part[k : k + most]


def _sum_keys(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(where, weights=np.concatenate([p[i] for p in parts]), minlength=len(keys)).astype(np.int64) for i in (1, 2))


def _counter(depth: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {WORD: [], RUN: []}
        size, docs = 0, [0, 0]

        def flush(least: int) -> Iterator[pd.DataFrame]:
            for kind, parts in held.items():
                if parts:
                    held[kind] = parts = [_sum_keys(parts)]
                    if len(parts[0][0]) >= least:
                        yield pd.DataFrame({"kind": kind, "key": parts[0][0], "n_train": parts[0][1], "n_all": parts[0][2]})
                        held[kind] = []

        for batch in batches:
            for train, rows in batch.groupby("train"):
                texts = [t or "" for t in rows["text"].tolist()]
                docs[0] += len(texts) * bool(train)
                docs[1] += len(texts)
                for chunk in _chunks(texts, depth):
                    for kind, keys in ((WORD, word_hashes(chunk, True)[0].view(np.int64)), (RUN, byte_runs(chunk, depth)[0])):
                        u, n = np.unique(keys, return_counts=True)
                        held[kind].append((u, n * bool(train), n))
                        size += len(u)
                    if size > FLUSH:
                        yield from flush(FLUSH // 4)
                        size = sum(len(p[0]) for parts in held.values() for p in parts)
        yield from flush(0)
        yield pd.DataFrame({"kind": [END], "key": [0], "n_train": [docs[0]], "n_all": [docs[1]]})

    return count


def count_keys(spark: SparkSession, docs: DataFrame, train: Column, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n_train, n_all): how often each word, byte run and the end occur, in training texts and in all."""
    small_batches(spark)
    rows = docs.select("text", train.alias("train")).mapInPandas(_counter(depth), COUNT_SCHEMA)
    return cut(spark, rows.groupBy("kind", "key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "counts")


def _log_gamma(x, log):
    """Stirling's series after seven steps of the recurrence; x is a half at least.  ``log``: numpy's for arrays, Spark's for columns."""
    steps = x
    for k in range(1, 7):
        steps = steps * (x + k)
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * log(y) - y + 0.9189385332046727 + series - log(steps)


def _kt(a, b, log):
    """Log of the Krichevsky-Trofimov estimate of ``a`` zeros and ``b`` ones."""
    return _log_gamma(a + 0.5, log) + _log_gamma(b + 0.5, log) - _log_gamma(a + b + 1, log) - float(np.log(np.pi))


def _mask(depth: int) -> int:
    """The bits of a node's number that name it at ``depth``: that many context bytes and the bit prefix."""
    return (1 << (8 * (depth + 1))) - 1


class Subtrees:
    """The nodes below whole contexts of ``unit`` bytes, from runs that are all of those contexts', as arrays level by level."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, unit: int):
        byte, k = keys & 255, np.arange(8)[:, None]
        node = (keys - byte) | (1 << k) | (byte >> (8 - k))  # eight decisions a run
        self.bit = (byte >> (7 - k)) & 1
        self.leaf, where = np.unique(node, return_inverse=True)
        self.where = where.reshape(node.shape)
        count = lambda bit: np.bincount(self.where.ravel(), weights=(n * (self.bit == bit)).ravel(), minlength=len(self.leaf))
        n0, n1 = count(0), count(1)
        log_w = _kt(n0, n1, np.log)
        self.mixed = (n1 + 0.5) / (n0 + n1 + 1)  # the chance of a one, by all contexts from ``unit`` bytes on
        own, nodes, path = self.mixed, self.leaf, []
        for d in range(depth - 1, unit - 1, -1):
            nodes, up = np.unique(nodes & _mask(d), return_inverse=True)
            n0, n1, below = (np.bincount(up, weights=x, minlength=len(nodes)) for x in (n0, n1, log_w))
            kt = _kt(n0, n1, np.log)
            log_w = np.logaddexp(kt, below) - np.log(2)
            path.append((up, 1 / (1 + np.exp(below - kt)), (n1 + 0.5) / (n0 + n1 + 1)))
        at = np.arange(len(self.leaf))
        for up, stay, own in path:
            at = up[at]
            self.mixed = stay[at] * own[at] + (1 - stay[at]) * self.mixed
        self.top = nodes, n0, n1, log_w

    def log10_p(self, p: np.ndarray) -> np.ndarray:
        """The log probability of each run's byte, from the chance of a one at each leaf node."""
        one = p[self.where]
        return np.log10(np.where(self.bit == 1, one, 1 - one)).sum(axis=0)


GROUP_ROWS = 100_000


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows, sorted by ``unit``, in tables of about GROUP_ROWS rows that hold all rows of their units."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= GROUP_ROWS:
            table = pd.concat(held, ignore_index=True)
            end = int(np.searchsorted(table["unit"].to_numpy(), table["unit"].iloc[-1]))  # the last unit may go on
            if end:
                yield table.iloc[:end]
            held, rows = [table.iloc[end:]], len(table) - end
    if rows:
        yield pd.concat(held, ignore_index=True)


def run_probabilities(spark: SparkSession, runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, log10_p, n_all) for every run (key, n_train, n_all): the weighted probability of its last byte after the others.

    Runs of one context of ``unit`` bytes meet in one task, where the levels from DEPTH to ``unit`` are arrays; such a group
    has 256 ** (depth - unit + 1) rows at most, whatever the corpus.  The levels above are grouped and
    joined as tables; what of them goes back by broadcast has 255 * 256 ** (unit - 1) rows at most.
    """
    unit = min(UNIT, depth)
    by_unit = runs.withColumn("unit", F.call_function("shiftright", F.col("key"), F.lit(8)).bitwiseAND(F.lit((1 << (8 * unit)) - 1)))
    by_unit = by_unit.repartition("unit").sortWithinPartitions("unit", "key")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in _whole_groups(batches):
            yield pd.DataFrame(dict(zip(("node", "n0", "n1", "log_w"), Subtrees(t["key"].to_numpy(), t["n_train"].to_numpy(), depth, unit).top)))

    level = cut(spark, by_unit.drop("n_all").mapInPandas(top, "node long, n0 double, n1 double, log_w double"), "level")
    levels = []
    for d in range(unit - 1, -1, -1):
        up = level.groupBy(F.col("node").bitwiseAND(F.lit(_mask(d)).cast("long")).alias("node"))
        up = up.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below")).withColumn("kt", _kt(F.col("n0"), F.col("n1"), F.log))
        more = F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("below"))))
        stay = 1 / (1 + F.exp(F.col("below") - F.col("kt")))
        level = cut(spark, up.select("node", "n0", "n1", (more - float(np.log(2))).alias("log_w"), stay.alias("stay")), "level")
        levels.insert(0, level)
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    path = levels[0].select("node", (F.col("stay") * one).alias("p"), (1 - F.col("stay")).alias("rest"))
    for d in range(1, unit):
        above = path.select(F.col("node").alias("up"), F.col("p").alias("up_p"), F.col("rest").alias("up_rest"))
        each = levels[d].withColumn("up", F.col("node").bitwiseAND(F.lit(_mask(d - 1)).cast("long"))).join(F.broadcast(above), "up")
        path = each.select(
            "node", (F.col("up_p") + F.col("up_rest") * F.col("stay") * one).alias("p"), (F.col("up_rest") * (1 - F.col("stay"))).alias("rest")
        )
    got = path.toArrow()
    shared = spark.sparkContext.broadcast(Scores(*(got.column(c).to_numpy() for c in ("node", "p", "rest"))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in _whole_groups(batches):
            tree = Subtrees(t["key"].to_numpy(), t["n_train"].to_numpy(), depth, unit)
            _, (p, rest) = shared.value.of(tree.leaf & _mask(unit - 1))
            yield pd.DataFrame({"key": t["key"].to_numpy(), "log10_p": tree.log10_p(p + rest * tree.mixed), "n_all": t["n_all"].to_numpy()})

    return cut(spark, by_unit.mapInPandas(score, "key long, log10_p double, n_all long"), "runs")


def _most_frequent(rows: DataFrame, top: int) -> DataFrame:
    """Rows of the largest n_all, ``top`` at most: those over the least bin bound that leaves no more."""
    binned = rows.withColumn("bin", F.floor(F.log2("n_all") * BINS))
    left, least = top, None
    for r in binned.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # BINS a doubling: some hundred rows
        left -= r["count"]
        if left < 0:
            break
        least = r["bin"]
    return binned.where(F.lit(False) if least is None else F.col("bin") >= least).drop("bin")


class Scores:
    """Sorted keys with values; ``of`` gives the values of keys and where they are missing."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        if not len(self.keys):
            return np.ones(len(keys), bool), [np.zeros(len(keys))] * len(self.values)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        missing = self.keys[at] != keys
        return missing, [np.where(missing, 0, v[at]) for v in self.values]


def _per_text(keys: np.ndarray, text: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs with their counts, sorted by key; keys below 2 ** (63 - bits)."""
    both, n = np.unique((keys << bits) | text, return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), n


def _lists(n_texts: int, text: np.ndarray, *values: np.ndarray) -> list[list[np.ndarray]]:
    order = np.argsort(text, kind="stable")
    cuts = np.searchsorted(text[order], np.arange(1, n_texts))
    return [np.split(v[order], cuts) for v in values]


FIRST_SCHEMA = (
    "row long, doc_id string, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, "
    "words array<long>, word_n array<long>, runs array<long>, run_n array<long>"
)


def _scorer(words: Broadcast, runs: Broadcast, depth: int, divisor: float, end: tuple[int, float]):
    bits = 63 - 8 * (depth + 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for chunk in _chunks([t or "" for t in batch["text"].tolist()], depth):
                n = len(chunk)
                h, bounds = word_hashes(chunk, True)
                n_words = np.diff(bounds)
                kinds, where = np.unique(h.view(np.int64), return_inverse=True)
                k, text, count = _per_text(where.astype(np.int64), np.repeat(np.arange(n), n_words), 24)
                missing, (c,) = words.value.of(kinds[k])
                known = np.bincount(text, weights=count * (c > 0), minlength=n)
                base = np.bincount(text, weights=count * np.where(missing, 0, np.log10((c + 0.5) / divisor)), minlength=n)
                rare_words = _lists(n, text[missing], kinds[k][missing], count[missing])
                key, text, count = _per_text(*byte_runs(chunk, depth), bits)
                missing, (p,) = runs.value.of(key)
                total = np.bincount(text, weights=count * p, minlength=n)
                rare_runs = _lists(n, text[missing], key[missing], count[missing])
                part = batch.iloc[at : at + n]
                yield pd.DataFrame(
                    {
                        "row": row + np.arange(n),
                        "doc_id": part["doc_id"].to_numpy(),
                        "held_out": part["held_out"].to_numpy(),
                        "n_bytes": np.array([len(t.encode("utf-8", "surrogatepass")) for t in chunk], dtype=np.int64),
                        "n_tokens": n_words + 1,
                        "n_known": known.astype(np.int64) + (end[0] > 0),
                        "base": base + end[1],
                        "score": total,
                        "words": rare_words[0],
                        "word_n": rare_words[1],
                        "runs": rare_runs[0],
                        "run_n": rare_runs[1],
                    }
                )
                at += n
                row += n

    return score


def score_texts(spark: SparkSession, docs: DataFrame, held_out: Column, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out.alias("held_out"))
    counts = count_keys(spark, docs, ~F.col("held_out"), depth)
    sums = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n_train").alias("n"), F.count_if(F.col("n_train") > 0).alias("v")).collect()}
    n_train = sum(sums[k].n for k in (WORD, END) if k in sums)
    divisor = n_train + 0.5 * (sum(sums[k].v for k in (WORD, END) if k in sums) + 1)
    ends = sums[END].n if END in sums else 0
    words = counts.where(F.col("kind") == WORD).select("key", "n_train", "n_all")
    runs = run_probabilities(spark, counts.where(F.col("kind") == RUN).select("key", "n_train", "n_all"), depth)

    def shared(rows: DataFrame, value: str) -> Broadcast:
        got = _most_frequent(rows, top).select("key", value).toArrow()
        return spark.sparkContext.broadcast(Scores(got.column("key").to_numpy(), got.column(value).to_numpy()))

    scorer = _scorer(shared(words, "n_train"), shared(runs, "log10_p"), depth, divisor, (ends, float(np.log10((ends + 0.5) / divisor))))
    first = cut(spark, docs.mapInPandas(scorer, FIRST_SCHEMA), "scores")
    each = first.select("row", F.explode(F.arrays_zip("words", "word_n")).alias("x")).select("row", "x.words", "x.word_n")
    c = F.coalesce(F.col("n_train"), F.lit(0))
    rare = each.join(words.select(F.col("key").alias("words"), "n_train"), "words").select(
        "row", (F.col("word_n") * F.log10((c + 0.5) / divisor)).alias("base"), F.when(c > 0, F.col("word_n")).otherwise(0).alias("known"), F.lit(0.0).alias("p")
    )
    each = first.select("row", F.explode(F.arrays_zip("runs", "run_n")).alias("x")).select("row", "x.runs", "x.run_n")
    rare = rare.union(
        each.join(runs.select(F.col("key").alias("runs"), "log10_p"), "runs").select(
            "row", F.lit(0.0), F.lit(0).cast("long"), F.col("run_n") * F.col("log10_p")
        )
    )
    rare = rare.groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"), F.sum("p").alias("more_p"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    score = F.col("score") + zero("more_p")
    return first.drop("words", "word_n", "runs", "run_n").join(rare, "row", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        score.alias("score"),
        (-score / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def score_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score_texts(spark, docs, crc_fold(F.col("doc_id"), 5) == 1)
