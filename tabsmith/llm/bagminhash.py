"""Near-duplicate classes by BagMinHash signatures of weighted word shingles.

A text is a multiset of five-word shingles.  For every shingle, the weights from 0 to its count
are discretised into the dyadic blocks (0,1], (1,2], (2,4], (4,8], ...; each block has a Poisson
process of points, seeded by shingle and block, at a rate of the block's width.  A point falls on
one signature component and, in a block that the weight covers in part, on one unit of the
block, found by halving; it counts if the weight reaches that unit.  A component keeps its
earliest point, so two signatures agree in a component with the probability of the weighted
Jaccard similarity.  Points of a process come in order of time, and a process stops once it is
later than the latest component of the text, so most shingles make one or two points.

Signatures are cut into bands.  In a bucket (texts equal in a band) every member is first compared
with one pivot; links of similarity ``threshold`` or more, verified on the multisets, form components.
Then only members of different components of a bucket are compared: those outside its largest component
are probes, sent in chunks to blocks of the bucket's members, where a task looks up the probes' shingles
in the block's and gives a link for each component met; pairs never become rows.  The components of all links are
the classes.  Members that are linked already need no comparison, so the classes are those of all pairs
in all buckets, with blocks of bounded size however large a bucket is.

Defined results: equal texts are one class, the empty text included; a null text is a class
of its own (with rows that repeat its id); a class is named by its least doc_id; rows without words have no
signature; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import cut, small_batches, text_chunks
from .components import components
from .shingles import MAX_TEXTS, mix64, pack, shingles, weighted_jaccard

BANDS = 25
ROWS = 5
SIZE = BANDS * ROWS
THRESHOLD = 0.8
CHUNK = 1_000_000
BLOCK = 512  # members of a bucket that a task holds
PROBES = 1_024  # probes that a task compares with them

_U = np.uint64


def signatures(texts: list[str], size: int = SIZE) -> np.ndarray:
    """The earliest point's time of each component, one row per text; infinite for texts without words."""
    element, count, bounds = shingles(texts)
    out = np.full((len(texts), size), np.inf)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    top = np.ceil(np.log2(count)).astype(np.int64) if len(count) else np.empty(0, np.int64)  # the block with the weight's last unit
    reps = top + 1
    which = np.repeat(np.arange(len(element)), reps)
    block = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
    text, weight = text[which], count[which]
    rate = np.where(block > 0, 1 << np.maximum(block - 1, 0), 1)
    units = np.where(block > 0, np.minimum(weight - rate, rate), 1)  # units of the block that the weight reaches
    seed = mix64(element[which] * _U(0x9E3779B97F4A7C15) + block.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    time = np.zeros(len(which))
    step = 0
    while len(text):
        step += 1
        u = mix64(seed + _U(step * 0xA0761D6478BD642F % 2**64))
        time = time - np.log(((u >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        latest = out.max(axis=1)
        alive = time < latest[text]
        if not alive.all():
            text, seed, time, rate, units, u = (x[alive] for x in (text, seed, time, rate, units, u))
        v = mix64(u + _U(0xE7037ED1A0B428DB))
        place = ((v >> _U(32)) * _U(size)) >> _U(32)
        hit = units >= rate
        part = np.flatnonzero(~hit)
        if len(part):  # halving the block as often as it has bits gives one unit of it
            unit = (v[part] & _U(0xFFFFFFFF)).astype(np.int64) & (rate[part] - 1)
            hit[part] = unit < units[part]
        if hit.all():
            np.minimum.at(out, (text, place.astype(np.int64)), time)
        else:
            np.minimum.at(out, (text[hit], place[hit].astype(np.int64)), time[hit])
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    bits = mix64(np.ascontiguousarray(sig).view(_U))
    bands = sig.shape[1] // rows
    key = np.zeros((len(sig), bands), dtype=_U)
    for k in range(rows):
        key = mix64(key + bits[:, k::rows][:, :bands] * _U(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def node_of(text: Column, doc_id: Column) -> Column:
    """128 bits of the text; a null text's row is known by its id."""
    own = F.md5(F.concat(F.lit("\x00null:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.unhex(F.coalesce(F.md5(text.cast("binary")), own))


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    for part in text_chunks(texts, CHUNK):
        for k in range(0, len(part), MAX_TEXTS):
            yield part[k : k + MAX_TEXTS]


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for chunk in _chunks(batch["text"].tolist()):
            sig = signatures(chunk)
            some = np.flatnonzero(np.isfinite(sig[:, 0]))
            if len(some):
                keys = band_keys(sig[some])
                nodes = [hashlib.md5(chunk[i].encode("utf-8", "surrogatepass")).digest() for i in some]
                yield pd.DataFrame({"node": nodes, "bands": list(keys)})


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes, at = batch["node"].tolist(), 0
        for chunk in _chunks(batch["text"].tolist()):
            element, count, bounds = shingles(chunk)
            packed = [pack(element[a:b], count[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pd.DataFrame({"node": nodes[at : at + len(chunk)], "profile": packed})
            at += len(chunk)


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _units(profile: bytes) -> tuple[np.ndarray, int]:
    """A packed multiset as a sorted set: the k-th copy of a shingle is a unit of its own; and its size."""
    packed = np.frombuffer(profile, _U)
    count = (packed & _U(0xFFFF)).astype(np.int64)
    if (count > 1).any():
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        packed = np.sort((np.repeat(packed >> _U(16), count) << _U(16)) + nth.astype(_U))
    else:
        packed = (packed >> _U(16)) << _U(16)
    return packed, int(count.sum())


def _compare(threshold: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links from the probes to the residents of other components, one for each component that a probe meets.

        A pair is looked at in the first band that the two share, so it is compared once.
        """
        band = rows["band"].iloc[0]
        home, probes = rows[~rows["probe"]].reset_index(drop=True), rows[rows["probe"]]
        links = []
        if len(home) and len(probes):
            units = [_units(p) for p in home["profile"]]
            unit, owner = np.concatenate([u for u, _ in units]), np.repeat(np.arange(len(home)), [len(u) for u, _ in units])
            order = np.argsort(unit, kind="stable")
            unit, owner = unit[order], owner[order]
            sizes = np.array([n for _, n in units])
            bands = np.array(home["bands"].tolist())
            comp, _ = pd.factorize(home["comp"])
            code = dict(zip(home["comp"], comp.tolist()))
            for node, own, profile, keys in zip(probes["node"], probes["comp"], probes["profile"], probes["bands"]):
                first = (bands == np.asarray(keys)).argmax(axis=1) == band
                first &= comp != code.get(own, -1)
                if not first.any():
                    continue
                mine, n = _units(profile)
                lo, hi = np.searchsorted(unit, mine), np.searchsorted(unit, mine, side="right")
                k = hi - lo
                at = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())
                both = np.bincount(owner[at], minlength=len(home))
                close = np.flatnonzero(first & (both >= threshold * (n + sizes - both)))
                if len(close):
                    _, one = np.unique(comp[close], return_index=True)
                    links += [(node, home["node"][i]) for i in close[one]]
        return pd.DataFrame(links, columns=["a", "b"])

    return compare


def near_classes(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, comp): the texts (128-bit digests) that have verified links, and the least text of their class."""
    small_batches(spark)
    texts = docs.select("text").where("text is not null")
    signed = texts.mapInPandas(_sign, "node binary, bands array<long>").groupBy("node").agg(F.first("bands").alias("bands"))
    signed = cut(spark, signed, "signatures")
    places = signed.select("node", F.posexplode("bands").alias("band", "key"))
    # One pivot per bucket; a bucket of one text needs nothing.
    pivots = places.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").drop("last")
    members = cut(spark, places.join(pivots, ["band", "key"]), "buckets")
    first = cut(spark, members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    found = members.select("node").distinct()
    profiles = texts.select(node_of(F.col("text"), F.lit("")).alias("node"), "text").join(found, "node", "left_semi").dropDuplicates(["node"])
    profiles = profiles.mapInPandas(_profile, "node binary, profile binary").join(signed, "node")
    profiles = cut(spark, profiles, "profiles")
    left = profiles.select(F.col("node").alias("a"), F.col("profile").alias("pa"))
    right = profiles.select(F.col("node").alias("b"), F.col("profile").alias("pb"))
    links = first.join(left, "a").join(right, "b").where(_similarity("pa", "pb") >= threshold).select("a", "b")
    links = cut(spark, links, "links")
    comps = components(spark, links)
    # What is left to compare: members of one bucket in different components.
    placed = members.join(comps, "node", "left").select("band", "key", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = placed.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n")).where("main.n < n")
    rest = placed.join(mixed, ["band", "key"]).withColumn("other", F.col("comp") != F.col("main.comp"))
    blocks, chunks = F.ceil(F.col("n") / BLOCK), F.ceil((F.col("n") - F.col("main.n")) / PROBES)
    entry = lambda block, chunk, probe: F.struct(block.cast("long").alias("block"), chunk.cast("long").alias("chunk"), F.lit(probe).alias("probe"))
    block, chunk = F.pmod(F.xxhash64("node"), blocks), F.pmod(F.xxhash64("node", F.lit(1)), chunks)
    as_home = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: entry(block, c, False))
    as_probe = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda c: entry(c, chunk, True))
    seats = F.when(F.col("other"), F.concat(as_home, as_probe)).otherwise(as_home)
    seated = rest.select("band", "key", "node", "comp", F.inline(seats)).join(profiles, "node")
    more = seated.groupBy("band", "key", "block", "chunk").applyInPandas(_compare(threshold), "a binary, b binary")
    more = cut(spark, more, "links")
    return comps if more.isEmpty() else components(spark, links.union(more))


def near_duplicate_classes(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, class_id, class_size): one row per document; class_id is the least doc_id of its class."""
    rows = docs.select("doc_id", node_of(F.col("text"), F.col("doc_id")).alias("node"))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    comps = near_classes(spark, docs, threshold)
    nodes = cut(spark, nodes.join(comps, "node", "left").select("node", "least", "n", F.coalesce("comp", "node").alias("comp")), "nodes")
    classes = nodes.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = nodes.join(classes, "comp").select("node", "class_id", "class_size", "comp")
    return rows.join(named, "node")


def near_duplicate_report(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return near_duplicate_classes(spark, docs, threshold).select("doc_id", "class_id", "class_size")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document (all columns) of each class: the one of the least doc_id, and of equal ids the least text."""
    found = near_duplicate_classes(spark, docs, threshold)
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    keepers = found.groupBy("comp").agg(F.min(best).alias("best")).select("best.node", F.col("best.doc_id").alias("__keep_id"))
    keepers = cut(spark, keepers.withColumnRenamed("node", "__keep_node"), "keepers")
    mark = "__keep_own"
    kept = docs.withColumn(mark, node_of(F.col("text"), F.col("doc_id")))
    kept = kept.join(keepers, (F.col(mark) == F.col("__keep_node")) & F.col("doc_id").eqNullSafe(F.col("__keep_id")))
    kept = kept.drop("__keep_node", "__keep_id")
    twice = found.groupBy("node", "doc_id").count().where("count > 1")
    if twice.isEmpty():
        return kept.drop(mark)
    # Whole rows that repeat an id and a text: one of them.
    return kept.dropDuplicates([mark]).drop(mark)
