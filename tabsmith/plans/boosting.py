"""Boosted trees over binned features: leaf-wise (best-first) and symmetric growth (M3, M4, M7, M8).

``pyspark.ml`` grows trees level by level; the two families rebuilt here are defined by another growth:

``leaf``       the leaf whose split gains most is split next, until a tree has ``leaves`` leaves.
``symmetric``  all nodes of a level share one split; a tree of depth d is d splits and 2^d leaves.

Rows are binned once (``bins`` quantile bounds a feature) and cached as one byte per feature.  A growth step is one
Spark job: each task sums gradients, hessians and counts by (node, feature, bin) over its rows, the sums are shuffled by
feature (and node) and added up there, and the driver gets the best split of each (node, feature): a number of rows
that depends on leaves and features only.

Best-first order needs no job per split.  A step takes the order that the known nodes give, and asks at once for the
children of all nodes it would split.  More known candidates can only push a node back in that order, so when
no child is missing the order is the best-first one; what was asked for beyond it is dropped.

Scores of finished trees are cached every ``REFRESH`` trees, always from the binned rows and the trees so far, so lineage
stays two steps long and a lost executor costs one pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

LEAF, SYMMETRIC = "leaf", "symmetric"
REFRESH = 10
# Fixed value: even quantiles that stand for the values of a feature with many.
SUMMARY = 2_048
_HIST = "node int, feature int, sums binary"
_BEST = "feature int, bin int, gain double, node int, gl double, hl double, nl double, g double, h double, n double"


@dataclass(frozen=True)
class Boosting:
    """Growth and budget; ``columns`` is the share of features drawn for each tree."""

    growth: str = LEAF
    trees: int = 120
    rate: float = 0.07
    leaves: int = 31
    depth: int = 5
    bins: int = 255
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    columns: float = 1.0
    seed: int = 42
    logistic: bool = False


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1 and points to itself."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, a, b
        for child in (a, b):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(child)
            self.right.append(child)
            self.value.append(0.0)
        return a, b

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each binned row."""
        feature, at, left, right = (np.asarray(v) for v in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            node = np.where(bins[rows, feature[node]] <= at[node], left[node], right[node])
        return node

    def score(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.place(bins)]


def bin_rows(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b holds edge[b-1] < x <= edge[b]; NaN falls into the last bin."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def gradients(score: np.ndarray, y: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    if not logistic:
        return score - y, np.ones_like(y)
    p = 1.0 / (1.0 + np.exp(-score))
    return p - y, np.maximum(p * (1.0 - p), 1e-16)


def histogram(bins: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, features: list[int], width: int) -> np.ndarray:
    """Sums of (gradient, hessian, rows) by node, feature and bin; ``at`` is the row's place among the nodes, -1 for none."""
    inside = at >= 0
    bins, at, g, h = bins[inside], at[inside], g[inside], h[inside]
    out = np.empty((nodes, len(features), width, 3))
    for j, f in enumerate(features):
        cell = at * width + bins[:, f]
        for k, weights in enumerate((g, h, None)):
            out[:, j, :, k] = np.bincount(cell, weights=weights, minlength=nodes * width).reshape(nodes, width)
    return out


def split_gains(sums: np.ndarray, p: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain of a split after each bin, sums to its left, sums of the node) for one node and feature."""
    left, total = np.cumsum(sums, axis=0)[:-1], sums.sum(axis=0)
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 0] ** 2 / (left[:, 1] + p.l2) + right[:, 0] ** 2 / (right[:, 1] + p.l2) - total[0] ** 2 / (total[1] + p.l2)
    enough = np.ones(len(gain), dtype=bool)
    for side in (left, right):
        enough &= (side[:, 2] >= p.min_rows) & (side[:, 1] >= p.min_hessian)
    return np.where(enough, gain, -np.inf), left, total


def best_splits(sums: dict[tuple[int, int], np.ndarray], p: Boosting) -> list[tuple]:
    """Rows of ``_BEST``: each node's best bin of each feature; for symmetric growth the bin that is best over all nodes."""
    out = []
    if p.growth == SYMMETRIC:
        by_feature: dict[int, list[int]] = {}
        for node, f in sorted(sums):
            by_feature.setdefault(f, []).append(node)
        for f, nodes in by_feature.items():
            found = [split_gains(sums[n, f], p) for n in nodes]
            # a node that a bin leaves whole gains nothing by it
            together = np.sum([np.where(np.isfinite(gain), gain, 0.0) for gain, _, _ in found], axis=0)
            b = int(np.argmax(together))
            out += [(f, b, float(together[b]), n, *map(float, left[b]), *map(float, total)) for n, (_, left, total) in zip(nodes, found)]
        return out
    for (node, f), s in sums.items():
        gain, left, total = split_gains(s, p)
        b = int(np.argmax(gain))
        out.append((f, b, float(gain[b]), node, *map(float, left[b]), *map(float, total)))
    return out


def grow(p: Boosting, best_of: Callable[[Tree, list[int]], list[tuple]]) -> Tree:
    """One tree; ``best_of(tree, nodes)`` gives the rows of ``_BEST`` for nodes of the (partly speculative) tree."""
    return _grow_symmetric(p, best_of) if p.growth == SYMMETRIC else _grow_leaf(p, best_of)


def _leaf_value(p: Boosting, g: float, h: float) -> float:
    return -p.rate * g / (h + p.l2) if h + p.l2 > 0 else 0.0


def _grow_leaf(p: Boosting, best_of) -> Tree:
    wide, known, sums, children = Tree(), {}, {}, {}
    asked = [0]
    while asked:
        for f, b, gain, node, gl, hl, nl, g, h, n in best_of(wide, asked):
            sums[node] = (g, h)
            if gain > 1e-12 and (node not in known or (-gain, f, b) < known[node]):
                known[node] = (-gain, f, b)
        order = _best_first(p, known, children)
        missing = [n for n in order if n not in children]
        for node in missing:
            children[node] = wide.split(node, known[node][1], known[node][2])
        wide.depth = _depth(wide)
        asked = [c for n in missing for c in children[n]]
    chosen, tree, names = set(order), Tree(), {0: 0}
    for node in order:  # parents come before children
        a, b = tree.split(names[node], known[node][1], known[node][2])
        names[children[node][0]], names[children[node][1]] = a, b
    for node, name in names.items():
        if node not in chosen and node in sums:
            tree.value[name] = _leaf_value(p, *sums[node])
    tree.depth = _depth(tree)
    return tree


def _best_first(p: Boosting, known: dict, children: dict) -> list[int]:
    """Nodes in the order in which they are split, as far as children are known."""
    heap, order = ([(known[0], 0)] if 0 in known else []), []
    while heap and len(order) < p.leaves - 1:
        _, node = heapq.heappop(heap)
        order.append(node)
        for child in children.get(node, ()):
            if child in known:
                heapq.heappush(heap, (known[child], child))
    return order


def _depth(tree: Tree) -> int:
    deepest, level = 0, [(0, 0)]
    while level:
        node, d = level.pop()
        deepest = max(deepest, d)
        if tree.feature[node] >= 0:
            level += [(tree.left[node], d + 1), (tree.right[node], d + 1)]
    return deepest


def _grow_symmetric(p: Boosting, best_of) -> Tree:
    tree, level = Tree(), [0]
    for depth in range(p.depth):
        rows = best_of(tree, level)
        if not rows:
            break
        gain, f, b = max(((r[2], -r[0], -r[1]) for r in rows))
        if gain <= 1e-12:
            break
        after = []
        for _, _, _, node, gl, hl, _, g, h, _ in sorted((r for r in rows if (r[0], r[1]) == (-f, -b)), key=lambda r: r[3]):
            left, right = tree.split(node, -f, -b)
            tree.value[left], tree.value[right] = _leaf_value(p, gl, hl), _leaf_value(p, g - gl, h - hl)
            after += [left, right]
        level, tree.depth = after, depth + 1
    return tree


def drawn_features(p: Boosting, tree: int, n: int) -> list[int]:
    """The features of a tree."""
    take = max(1, int(round(p.columns * n)))
    return sorted(np.random.default_rng([p.seed, tree]).permutation(n)[:take].tolist())


@dataclass
class BoostedModel:
    params: Boosting
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]
    features_col: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``; for two classes also ``probability``."""
        edges, trees, start = self.edges, self.trees, self.start

        @F.pandas_udf("double")
        def raw(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="float64")
            bins = bin_rows(np.stack(features.to_numpy()), edges)
            return pd.Series(start + sum((t.score(bins) for t in trees), np.zeros(len(bins))))

        ship_package(df.sparkSession)
        score = raw(vector_to_array(self.features_col))
        if not self.params.logistic:
            return df.withColumn("prediction", score)
        out = df.withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-score)))
        out = out.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - F.col("_p"), F.col("_p"))))
        return out.withColumn("prediction", (F.col("_p") >= 0.5).cast("double")).drop("_p")


def _binned(df: DataFrame, features_col: str, label_col: str, edges: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
                rows = [r.tobytes() for r in bin_rows(x, edges)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["bins", "y"])

    return df.select(vector_to_array(features_col).alias("x"), F.col(label_col).cast("double").alias("y")).mapInArrow(run, "bins binary, y double")


def _unpacked(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    packed = b"".join(batch.column("bins").to_pylist())
    return np.frombuffer(packed, dtype=np.uint8).reshape(batch.num_rows, n), batch.column("y").to_numpy(zero_copy_only=False)


def _scored(binned: DataFrame, n: int, start: float, trees: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y = _unpacked(batch, n)
            score = start + sum((t.score(bins) for t in trees), np.zeros(len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.array(score)], ["bins", "y", "score"])

    return binned.mapInArrow(run, "bins binary, y double, score double")


def _histograms(scored: DataFrame, n: int, recent: list[Tree], tree: Tree, nodes: list[int], features: list[int], width: int, logistic: bool) -> DataFrame:
    """One row per task, node and feature with the sums over the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y = _unpacked(batch, n)
            score = batch.column("score").to_numpy(zero_copy_only=False) + sum((t.score(bins) for t in recent), np.zeros(len(y)))
            g, h = gradients(score, y, logistic)
            part = histogram(bins, slot[tree.place(bins)], g, h, len(nodes), features, width)
            total = part if total is None else total + part
        if total is not None:
            ids = np.repeat(np.asarray(nodes, dtype=np.int32), len(features))
            sums = [total[i, j].tobytes() for i in range(len(nodes)) for j in range(len(features))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.tile(np.asarray(features, dtype=np.int32), len(nodes))), pa.array(sums, pa.binary())],
                ["node", "feature", "sums"],
            )

    return scored.mapInArrow(run, _HIST)


def _best(histograms: DataFrame, p: Boosting, parts: int) -> list[tuple]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for node, f, packed in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(packed).reshape(-1, 3)
                sums[node, f] = sums[node, f] + part if (node, f) in sums else part
        rows = best_splits(sums, p)
        if rows:
            names = [c.split()[0] for c in _BEST.split(", ")]
            kinds = [pa.int32() if c.endswith(" int") else pa.float64() for c in _BEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    keys = ["feature"] if p.growth == SYMMETRIC else ["node", "feature"]
    return [tuple(r) for r in histograms.repartition(parts, *keys).mapInArrow(run, _BEST).collect()]


def quantile_edges(df: DataFrame, features_col: str, bins: int) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature but the last: values at even quantiles, all features in one aggregation."""
    first = df.select(F.size(vector_to_array(features_col)).alias("n")).first()
    if first is None:
        raise ValueError("boosting needs at least one training row")
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    x = df.select(vector_to_array(features_col).alias("x")).select(*[F.col("x")[j].alias(f"f{j}") for j in range(first["n"])])
    found = x.agg(*[F.percentile_approx(c, at, F.lit(10_000)).alias(c) for c in x.columns]).first()
    tops = x.agg(*[F.max(c).alias(c) for c in x.columns]).first()
    # the largest value bounds nothing: no row lies beyond it
    return [np.unique([v for v in (e or []) if v < top]) for e, top in zip(found, tops)]


def even_edges(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Bounds between ascending distinct values, as ``pyspark.ml`` places them for its trees.

    Up to ``bins`` values are all told apart.  Of more, the k-th bound stands before the value whose middle rank passes the k-th
    of ``bins`` even shares; after a heavy value, which passes several shares at once, each next value gets a bound until they are made up for.
    """
    between = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return between
    middle, share = np.cumsum(weights) - weights / 2, weights.sum() / bins
    edges: list[float] = []
    for i in range(1, len(values)):
        if middle[i] > (len(edges) + 1) * share:
            edges.append(between[i - 1])
    return np.asarray(edges)


def tree_edges(df: DataFrame, features_col: str, bins: int) -> list[np.ndarray]:
    """``even_edges`` of each feature over all rows: of its values where they are few, else of ``SUMMARY`` even quantiles."""
    first = df.select(F.size(vector_to_array(features_col)).alias("n")).first()
    if first is None:
        raise ValueError("boosting needs at least one training row")
    x = df.select(vector_to_array(features_col).alias("x")).select(*[F.col("x")[j].alias(f"f{j}") for j in range(first["n"])])
    about = x.agg(*[F.approx_count_distinct(c).alias(c) for c in x.columns]).first()
    few = {c for c in x.columns if about[c] <= 2 * bins}  # the estimate is off by some per cent
    at = F.expr(f"array({', '.join(f'{i / SUMMARY!r}D' for i in range(1, SUMMARY))})")
    found = x.agg(*[(F.collect_set(c) if c in few else F.percentile_approx(c, at, F.lit(10_000))).alias(c) for c in x.columns]).first()
    edges = []
    for c in x.columns:
        values, weights = np.unique(np.asarray(found[c], dtype="float64"), return_counts=True)
        if c in few and len(values) > bins:  # a few values too many: how often each occurs decides
            counts = {r[c]: r["count"] for r in x.groupBy(c).count().collect()}
            weights = np.asarray([counts[v] for v in values])
        edges.append(even_edges(values, weights, bins))
    return edges


def bin_column(features_col: str, edges: list[np.ndarray]) -> Column:
    """The bins of a feature vector as an array of doubles."""

    @F.arrow_udf("array<double>")
    def bins(x: pa.Array) -> pa.Array:
        n = len(edges)
        at = bin_rows(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), n), edges) if len(x) else np.empty((0, n))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(at.astype("float64").ravel()))

    return bins(vector_to_array(features_col))


def fit(df: DataFrame, params: Boosting, features_col: str = "features", label_col: str = "label") -> BoostedModel:
    """Fit on all rows of ``df``.  Null labels teach nothing; a constant label gives trees without a split."""
    ship_package(df.sparkSession)
    p = replace(params, bins=min(params.bins, 255))
    rows = df.where(F.col(label_col).isNotNull())
    edges = quantile_edges(rows, features_col, p.bins)
    width, n = max(len(e) for e in edges) + 1, len(edges)
    binned = _binned(rows, features_col, label_col, edges).persist(StorageLevel.MEMORY_AND_DISK)
    mean = binned.agg(F.avg("y")).first()[0]
    start = float(np.log(max(mean, 1e-12) / max(1.0 - mean, 1e-12))) if p.logistic else float(mean)
    parts = df.sparkSession.sparkContext.defaultParallelism
    trees: list[Tree] = []
    done, scored = 0, None
    try:
        for k in range(p.trees if width > 1 else 0):
            if scored is None or k - done == REFRESH:
                fresh = _scored(binned, n, start, list(trees)).persist(StorageLevel.MEMORY_AND_DISK)
                if scored is not None:
                    scored.unpersist()
                done, scored = k, fresh
            features = drawn_features(p, k, n)

            def best_of(tree: Tree, nodes: list[int]) -> list[tuple]:
                hist = _histograms(scored, n, trees[done:], tree, nodes, features, width, p.logistic)
                return _best(hist, p, min(parts, len(features) * (1 if p.growth == SYMMETRIC else len(nodes))))

            trees.append(grow(p, best_of))
            if trees[-1].depth == 0 and p.columns >= 1.0:
                break  # no split gains: every later tree would be the same
    finally:
        binned.unpersist()
        if scored is not None:
            scored.unpersist()
    return BoostedModel(p, edges, start, trees, features_col)
