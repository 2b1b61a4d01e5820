"""Leaf-wise and symmetric growth on Spark against a plain in-memory twin that splits one leaf at a time."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabsmith.plans import boosting as bo
from tabsmith.plans import evaluate as ev
from tabsmith.plans import models as md
from tabsmith.plans.preprocess import TREE


def _frame(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = np.round(np.where(x[:, 0] > 0, x[:, 1] * 2, np.sin(x[:, 2] * 3)) + rng.normal(size=n) * 0.1, 3)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, label double").repartition(5)
    return x, y, df.select(array_to_vector("x").alias("features"), "label")


def _side(s, p):
    return s[0] ** 2 / (s[1] + p.l2)


def _splits(x, g, h, rows, p):
    """All splits of a set of rows as (gain, feature, threshold)."""
    out = []
    for f in range(x.shape[1]):
        for t in np.unique(x[rows, f])[:-1]:
            left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
            if min(len(left), len(right)) < p.min_rows or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                continue
            parts = [(g[r].sum(), h[r].sum()) for r in (left, right, rows)]
            out.append((_side(parts[0], p) + _side(parts[1], p) - _side(parts[2], p), f, t))
    return out


def _twin_leaf(x, y, p):
    """Best-first trees by trying every split of every leaf again for each split."""
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())) if p.logistic else y.mean())
    counts = []
    for _ in range(p.trees):
        g, h = bo.gradients(score, y, p.logistic)
        leaves = [np.arange(len(y))]
        while len(leaves) < p.leaves:
            options = [max(_splits(x, g, h, rows, p), key=lambda s: s[0], default=(0.0, 0, 0.0)) for rows in leaves]
            i = int(np.argmax([o[0] for o in options]))
            gain, f, t = options[i]
            if gain <= 1e-12:
                break
            rows = leaves.pop(i)
            leaves += [rows[x[rows, f] <= t], rows[x[rows, f] > t]]
        for rows in leaves:
            score[rows] -= p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
        counts.append(sorted(len(r) for r in leaves))
    return score, counts


def _twin_symmetric(x, y, p):
    score = np.full(len(y), y.mean())
    for _ in range(p.trees):
        g, h = bo.gradients(score, y, False)
        leaves = [np.arange(len(y))]
        for _ in range(p.depth):
            total = {}
            for rows in leaves:
                for gain, f, t in _splits(x, g, h, rows, p):
                    total[f, t] = total.get((f, t), 0.0) + gain
            # a value between two of a leaf's own values cuts it like the next lower one
            for f, t in list(total):
                total[f, t] = 0.0
                for rows in leaves:
                    left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                    if min(len(left), len(right)) >= p.min_rows:
                        parts = [(g[r].sum(), h[r].sum()) for r in (left, right, rows)]
                        total[f, t] += _side(parts[0], p) + _side(parts[1], p) - _side(parts[2], p)
            (f, t), _ = max(total.items(), key=lambda e: e[1])
            leaves = [side for rows in leaves for side in (rows[x[rows, f] <= t], rows[x[rows, f] > t])]
        for rows in leaves:
            if len(rows):
                score[rows] -= p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
    return score


def _predicted(model, df, x):
    got = model.transform(df.withColumn("i", F.monotonically_increasing_id()))
    return {tuple(r["features"].toArray()): r for r in got.collect()}


@pytest.mark.parametrize("logistic", [False, True])
def test_leaf_growth_equals_the_twin(spark, logistic):
    x, y, df = _frame(spark)
    if logistic:
        y, df = (y > 0.3).astype(float), df.withColumn("label", (F.col("label") > 0.3).cast("double"))
    p = bo.Boosting(trees=3, leaves=31, rate=0.3, logistic=logistic)
    model = bo.fit(df, p)
    score, counts = _twin_leaf(x, y, p)
    assert max(len(c) for c in counts) == (21 if logistic else 31)  # pure leaves end early
    for tree, want in zip(model.trees, counts):
        at = tree.place(bo.bin_rows(x, model.edges))
        assert sorted(np.unique(at, return_counts=True)[1].tolist()) == want
    got = _predicted(model, df, x)
    want = 1 / (1 + np.exp(-score)) if logistic else score
    for row, w in zip(x, want):
        r = got[tuple(row)]
        assert abs((r["probability"][1] if logistic else r["prediction"]) - w) < 1e-8


def test_symmetric_growth_equals_the_twin(spark):
    x, y, df = _frame(spark)
    p = bo.Boosting(growth=bo.SYMMETRIC, trees=3, depth=3, rate=0.3, l2=3.0, min_rows=1)
    model = bo.fit(df, p)
    got = _predicted(model, df, x)
    for row, w in zip(x, _twin_symmetric(x, y, p)):
        assert abs(got[tuple(row)]["prediction"] - w) < 1e-8
    for tree in model.trees:  # one split a level
        level = [0]
        for _ in range(tree.depth):
            assert len({(tree.feature[n], tree.bin[n]) for n in level}) == 1
            level = [c for n in level for c in (tree.left[n], tree.right[n])]


def test_scores_stay_right_over_a_refresh(spark):
    x, y, df = _frame(spark, n=300)
    p = bo.Boosting(trees=bo.REFRESH + 2, leaves=4)
    got = _predicted(bo.fit(df, p), df, x)
    for row, w in zip(x, _twin_leaf(x, y, p)[0]):
        assert abs(got[tuple(row)]["prediction"] - w) < 1e-8


def test_constant_label_and_feature(spark):
    df = spark.createDataFrame([([1.0, 2.0], 5.0)] * 50, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    assert {r["prediction"] for r in bo.fit(df, bo.Boosting(trees=2)).transform(df).collect()} == {5.0}


def test_family_growth_in_the_evaluation(spark):
    df = spark.createDataFrame([(i, float(i % 42), float(i % 42) * 2) for i in range(252)], "id int, x double, target double")
    res = ev.evaluate_candidates(
        df, df.drop("target"), target="target", key="id", task_type="regression", validation_scheme="kfold",
        candidates=["lightgbm_regressor", "catboost_regressor"], n_splits=2, trees=2, growth="family",
    )
    board = res.leaderboard.collect()
    assert {r["status"] for r in board} == {"ok"}, board
    assert all(r["score"] > -24.0 for r in board)  # better than a constant's -24.2
    assert res.oof.count() == 504 and res.test_predictions.count() == 504
    with pytest.raises(ValueError, match="unsupported growth"):
        md.estimator("lightgbm_regressor", "regression", n_train=1, growth="other")


def test_family_growth_of_several_classes(spark):
    rows = [([float(i % 42)], float(i % 42 // 14)) for i in range(252)]
    df = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias(TREE), "label")
    model = md.estimator("lightgbm_classifier", "multiclass_classification", n_train=252, n_classes=3, trees=1, growth="family").fit(df)
    assert model.transform(df).where(F.col("prediction") != F.col("label")).count() == 0


def _codes(spark, classes=0, n=3000):
    """Few distinct rows: 100 values of which one is heavy (more than a tree has bins), 3 and 40 values."""
    rng = np.random.default_rng(7)
    x = np.stack([np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 100, n)), rng.integers(-1, 2, n), rng.integers(0, 40, n) / 8], axis=1)
    y = x[:, 0] * 0.1 + np.sin(x[:, 2]) * (x[:, 1] + 2) + rng.normal(size=n)
    y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float) if classes else y
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, x array<double>, label double")
    return df.repartition(3).select("i", array_to_vector("x").alias(TREE), "label")


@pytest.mark.parametrize("name,classes", [("lightgbm_regressor", 0), ("catboost_classifier", 2), ("lightgbm_classifier", 3)])
def test_trees_on_merged_rows_equal_trees_on_all_rows(spark, monkeypatch, name, classes):
    df = _codes(spark, classes).cache()
    kind = {0: "regression", 2: "binary_classification", 3: "multiclass_classification"}[classes]
    fit = lambda: md.estimator(name, kind, n_train=3000, n_classes=classes, trees=3).fit(df)
    plain = fit()
    monkeypatch.setattr(md, "MERGE_ROWS", 0)
    merged = fit()
    assert isinstance(merged, md.BinnedModel)
    test = df.withColumn(TREE, array_to_vector(F.transform(vector_to_array(TREE), lambda v: v + 0.5)))  # values that training has not seen
    for rows in (df, test):
        want, got = ({r["i"]: r for r in m.transform(rows).collect()} for m in (plain, merged))
        assert len(got) == 3000
        for i, r in got.items():
            assert abs(r["prediction"] - want[i]["prediction"]) < 1e-6
            if classes == 2:
                assert abs(r["probability"][1] - want[i]["probability"][1]) < 1e-6


def test_large_training_sides_are_merged_by_bins(spark):
    df = spark.range(20_000).select(
        array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") * 7919 % 20_011).cast("double"))).alias(TREE),
        (F.col("id") % 13).cast("double").alias("label"),
    )
    trees = md.estimator("lightgbm_regressor", "regression", n_train=20_000, trees=1)
    edges = bo.tree_edges(df, TREE, md.MAX_BINS)
    assert edges[0].tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and len(edges[1]) == 63
    merged = trees.merged(df, edges).collect()
    assert len(merged) <= 7 * 64 and sum(r[md.ROWS] for r in merged) == 20_000
    assert abs(sum(r["label"] * r[md.ROWS] for r in merged) - sum(i % 13 for i in range(20_000))) < 1e-6
    share = np.zeros(64)
    for r in merged:
        share[int(r[md.BINS][1])] += r[md.ROWS]
    assert share.min() > 0.9 * 20_000 / 64 and share.max() < 1.1 * 20_000 / 64
    assert isinstance(md.estimator("lightgbm_regressor", "regression", n_train=10_000), md.GBTRegressor)
