"""Benchmark decontamination: a broadcast hash set of normalised test windows, probed by token windows.

Words are lower-cased ASCII letters, digits and all characters from U+0080 on.  A benchmark
item contributes every run of ``width`` consecutive words, or its whole text when it is
shorter.  Each batch of documents is turned into word numbers of the benchmark's vocabulary;
a 64-bit polynomial hash of every window is looked up in the hash set, and each hit is verified
word by word before it counts.

The benchmark is cut into blocks of at most ``block_bytes`` of text by a hash of its rows; each
block is broadcast on its own, so what is broadcast has a fixed bound however large the
benchmark is.  One block is the usual case; more blocks add further passes over the texts.

Defined results: a null or wordless document has no hits; a null or wordless item has no window;
equal item ids of repeated rows count once and a null item id is written as the empty string;
repeated documents are judged row by row; other columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_chunks

WIDTH = 13
BLOCK_BYTES = 32 * 1024 * 1024

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z (A-Z lower-cased), every byte from 0x80 on.
_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _powers(n: int) -> np.ndarray:
    out, p = [], 1
    for _ in range(n):
        p = p * 0x9E3779B97F4A7C15 % 2**64
        out.append(p)
    return np.array(out, dtype=np.uint64)


class WindowSet:
    """The windows of one benchmark block: vocabulary, window hashes by length, items of each window."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.vocab: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, set[str]]] = {}
        for item_id, text in items:
            words = normal_words(text)
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int32)
            size = min(width, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                self.items.setdefault(size, {}).setdefault(ids[i : i + size].tobytes(), set()).add(item_id)
        self.hashes = {
            size: np.unique([self._hash(np.frombuffer(w, np.int32)[None, :])[0] for w in found]) for size, found in self.items.items()
        }

    @staticmethod
    def _hash(windows: np.ndarray) -> np.ndarray:
        return (windows.astype(np.uint64) * _powers(windows.shape[1])).sum(axis=1, dtype=np.uint64)

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Per text: its word count, the hit word positions, the ids of the items found."""
        ids, sizes = [], []
        for t in texts:
            words = normal_words(t)
            sizes.append(len(words))
            ids.extend(map(self.vocab.get, words, repeat(0)))
            ids.append(0)  # no window reaches over the end of a text
        seq = np.array(ids, dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)])
        known = np.concatenate([[0], np.cumsum(seq != 0)])
        edge = np.zeros(len(seq) + 1, dtype=np.int32)
        found: dict[int, set[str]] = {}
        for size, hashes in self.hashes.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(seq) >= size else np.empty(0, np.int64)
            for part in np.array_split(at, len(at) // 200_000 + 1):
                windows = seq[part[:, None] + np.arange(size)]
                h = self._hash(windows)
                near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for k in np.flatnonzero(hashes[near] == h):
                    owners = self.items[size].get(windows[k].tobytes())
                    if owners is not None:  # verified word by word
                        edge[part[k]] += 1
                        edge[part[k] + size] -= 1
                        doc = int(np.searchsorted(starts, part[k], side="right")) - 1
                        found.setdefault(doc, set()).update(owners)
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        owner = np.searchsorted(starts, hit, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        places = [(hit[a:b] - starts[d]).tolist() for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        return sizes, places, [sorted(found.get(d, ())) for d in range(len(texts))]


def window_blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[WindowSet]:
    """The benchmark's windows, block by block; each block holds about ``block_bytes`` of text at most."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("words")
    )
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k)
        yield WindowSet([(r.item, r.words) for r in block.toLocalIterator()], width)


def _scanner(shared: Broadcast):
    @F.pandas_udf("n_words long, hit array<int>, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [[], [], []]
            for chunk in text_chunks([t or "" for t in batch.tolist()]):
                for part, add in zip(out, shared.value.scan(chunk), strict=True):
                    part.extend(add)
            yield pd.DataFrame({"n_words": out[0], "hit": out[1], "items": out[2]})

    return scan


def contamination(
    spark: SparkSession, text: Column, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> Column:
    """Column of struct(n_words long, hit array<int>, items array<string>) for each text."""
    small_batches(spark)
    found = []
    for block in window_blocks(benchmark, width, block_bytes):
        scan = _scanner(spark.sparkContext.broadcast(block))
        found.append(scan(text))
    if len(found) == 1:
        return found[0]
    each = F.array(*found)
    return F.struct(
        each[0]["n_words"].alias("n_words"),
        F.array_distinct(F.flatten(F.transform(each, lambda x: x["hit"]))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(each, lambda x: x["items"])))).alias("items"),
    )


def is_contaminated(found: Column) -> Column:
    hits = F.size(found["hit"])
    return (hits > 0) & (20 * hits >= found["n_words"])


def contamination_report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """One row per document: word and hit counts, items found, digest of their ids, verdict."""
    found = docs.select("doc_id", contamination(spark, F.col("text"), benchmark, **kw).alias("found"))
    f = F.col("found")
    return found.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        F.size(f["hit"]).cast("long").alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(f).alias("contaminated"),
    )


def remove_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents (all columns) that the contamination rule leaves."""
    mark = "__decontaminate_found"
    found = docs.withColumn(mark, contamination(spark, F.col("text"), benchmark, **kw))
    return found.where(~is_contaminated(F.col(mark))).drop(mark)


def remove_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents with the hit words cut out of their texts and the count ``n_chars``, where there is one, renewed.

    Words are cut with what separates them inside a hit run; texts without a hit stay as they are.
    """
    mark = "__decontaminate_found"

    @F.pandas_udf("string")
    def without(text: pd.Series, hit: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, h) for t, h in zip(text, hit, strict=True)], dtype=object)

    found = docs.withColumn(mark, contamination(spark, F.col("text"), benchmark, **kw))
    hits = F.col(mark)["hit"]
    found = found.withColumn("text", F.when(F.size(hits) > 0, without("text", hits)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(hits) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.drop(mark)


def cut_words(text: str | None, hit) -> str | None:
    if text is None or hit is None or not len(hit):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat, spans, at = raw.translate(_TABLE), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    out, pos = [], 0
    hits = sorted(int(h) for h in hit)
    for k, h in enumerate(hits):
        a, b = spans[h]
        if k and hits[k - 1] == h - 1:
            pos = b
            continue
        out.append(raw[pos:a])
        pos = b
    out.append(raw[pos:])
    return b"".join(out).decode("utf-8", "surrogatepass")


REPORT_SQL = f"""
with doc as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark),
win as (
  select distinct item_id, least(len(w), {WIDTH}) as size, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') as words
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) as i from item where len(w) > 0)),
place as (
  select r, size, i, array_to_string(w[i:i + size - 1], ' ') as words
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i
        from doc, (select distinct size from win) where len(w) >= size)),
hit as (select p.r, p.size, p.i, w.item_id from place p join win w on p.size = w.size and p.words = w.words),
pos as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + size)) as j from hit) group by r),
own as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
        from (select distinct r, coalesce(cast(item_id as varchar), '') as id from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join pos using (r) left join own using (r)
"""
