"""End-to-end evaluation on small frames (FX-A5, FX-A6) and preset/alias rules."""

import pytest
from pyspark.sql import functions as F

from tabsmith.plans import evaluate as ev
from tabsmith.plans import models as md
from tabsmith.plans import preprocess as pp


def _fx_a5(spark):
    train = spark.createDataFrame(
        [(1, 0.1, 1.0, 0), (2, 0.2, 0.9, 0), (3, 0.3, 0.8, 0), (4, 0.9, 0.1, 1), (5, 0.8, 0.2, 1), (6, 0.7, 0.3, 1)],
        "id int, x1 double, x2 double, target int",
    )
    test = spark.createDataFrame([(7, 0.15, 0.95), (8, 0.85, 0.15)], "id int, x1 double, x2 double")
    sample = spark.createDataFrame([(7, 0), (8, 0)], "id int, target int")
    return train, test, sample


def test_binary_evaluation(spark):
    train, test, sample = _fx_a5(spark)
    res = ev.evaluate_candidates(train, test, sample, candidates=["logreg"], n_splits=2, validation_scheme="stratified_kfold")
    assert res.task_type == "binary_classification" and res.prediction_mode == "proba"
    board = res.leaderboard.collect()
    assert board[0]["name"] == "logistic_regression" and board[0]["status"] == "ok"
    assert res.best["name"] == "logistic_regression"
    oof = res.oof.collect()
    assert len(oof) == 6 and len({r["id"] for r in oof}) == 6  # every row exactly once
    preds = {r["id"]: r["predicted_label"] for r in res.test_predictions.collect()}
    assert preds == {7: 0, 8: 1}


def test_regression_evaluation(spark):
    rows = [(i, float(i), float(i % 3), float(i) + float(i % 3)) for i in range(1, 7)]
    train = spark.createDataFrame(rows, "id int, x1 double, x2 double, target double")
    test = spark.createDataFrame([(7, 7.0, 1.0), (8, 8.0, 2.0)], "id int, x1 double, x2 double")
    sample = spark.createDataFrame([(7, 0.0), (8, 0.0)], "id int, target double")
    res = ev.evaluate_candidates(train, test, sample, candidates=["linear"], n_splits=2, validation_scheme="kfold")
    b = res.leaderboard.first()
    assert res.task_type == "regression" and res.prediction_mode == "numeric"
    assert b["score"] > -1e-6  # target = x1 + x2 exactly
    preds = sorted(r["prediction"] for r in res.test_predictions.collect())
    assert abs(preds[0] - 8.0) < 1e-6 and abs(preds[1] - 10.0) < 1e-6


def test_failing_candidate_does_not_fail_others(spark):
    train, test, sample = _fx_a5(spark)
    res = ev.evaluate_candidates(train, test, sample, candidates=["logreg", "tfidf"], n_splits=2, validation_scheme="kfold")
    st = {r["name"]: (r["status"], r["error"]) for r in res.leaderboard.collect()}
    assert st["logistic_regression"][0] == "ok"
    assert st["tfidf_linear"][0] == "error" and "text column" in st["tfidf_linear"][1]


def test_unknown_candidate_rejected_before_jobs(spark):
    train, test, sample = _fx_a5(spark)
    with pytest.raises(ValueError, match="Unsupported candidate"):
        ev.evaluate_candidates(train, test, sample, candidates=["no_such_model"], n_splits=2)


def test_presets_parameters():
    gbt = md.estimator("lightgbm_classifier", "binary_classification", n_train=100)
    assert gbt.getMaxIter() == 120 and gbt.getStepSize() == 0.07 and gbt.getMaxDepth() == 5 and gbt.getSubsamplingRate() == 1.0
    gbt = md.estimator("xgboost_regressor", "regression", n_train=10**9, trees=80)
    assert gbt.getMaxIter() == 80 and gbt.getMaxDepth() == 4 and gbt.getSubsamplingRate() == 0.8
    lr = md.estimator("logistic_regression", "binary_classification", n_train=100)
    assert lr.getMaxIter() == 250 and abs(lr.getRegParam() - 0.01) < 1e-12
    assert md.estimator("tfidf_linear", "binary_classification", n_train=10).getFeaturesCol() == "features"
    with pytest.raises(ValueError, match="text column"):
        md.fit_text(None, None)


def test_every_row_is_scored_and_the_fit_bound_is_explicit(spark):
    rows = [(i, float(i % 7), "ab"[i % 2], i % 2) for i in range(90)] + [(90, None, None, 0)]
    train = spark.createDataFrame(rows, "id int, x double, c string, target int")
    res = ev.evaluate_candidates(train, None, None, target="target", key="id", candidates=["logreg", "logistic"], n_splits=3, fit_rows=20,
                                 validation_scheme="stratified_kfold")
    assert [r["name"] for r in res.leaderboard.collect()] == ["logistic_regression"]  # aliases of one model run once
    assert res.eval_rows == 91 and sorted(r["id"] for r in res.oof.collect()) == list(range(91)) and res.fit_notes
    with pytest.raises(ValueError, match="classifiers"):
        ev.evaluate_candidates(train, None, None, target="x", key="id", candidates=["linear"], fit_rows=20, validation_scheme="kfold")


def test_metric_scheme_and_artifacts(spark):
    rows = [(i, float(i), float(2 * i) * 1e5) for i in range(30)]
    train = spark.createDataFrame(rows, "id int, x double, target double")
    test = spark.createDataFrame([(100, 5.0)], "id int, x double")
    res = ev.evaluate_candidates(train, test, None, target="target", key="id", candidates=["linear"], validation_scheme="grouped_kfold_recommended")
    assert res.validation_scheme == "kfold"  # the scheme that ran
    assert len(res.best["fold_scores"]) == 3 and all(isinstance(x, float) for x in res.best["fold_scores"])
    stored = ev.load_artifact(spark, res.best["artifact_ref"])
    assert stored["oof"].count() == 30 and "label" in stored["oof"].columns
    assert abs(stored["test"].first()["prediction"] - 1e6) < 1e-3
    with pytest.raises(ValueError, match="Unknown artifact_ref"):
        ev.load_artifact(spark, res.artifact_path + "#nope")
    for bad in ({"validation_scheme": "nope"}, {"metric_family": "auc"}, {"validation_scheme": "group_kfold"}):
        with pytest.raises(ValueError):
            ev.evaluate_candidates(train, test, None, target="target", key="id", candidates=["linear"], **bad)
    # the metric asked for is the one computed: class indexes 0/1 give -sqrt(error rate)
    cls = spark.createDataFrame([(i, float(i % 5), i % 2) for i in range(60)], "id int, x double, target int")
    args = dict(target="target", key="id", candidates=["logreg"], validation_scheme="stratified_kfold")
    acc, rmse = (ev.evaluate_candidates(cls, None, None, metric_family=m, **args).leaderboard.first() for m in ("accuracy", "neg_rmse"))
    assert all(abs(b + (1 - a) ** 0.5) < 1e-12 for a, b in zip(acc["fold_scores"], rmse["fold_scores"]))


def test_fold_scores_are_numbers_and_nan_does_not_win(spark):
    scores = spark.createDataFrame([("a", 0, -54321.123456), ("a", 1, -1234567.5)], "candidate string, fold int, score double")
    pos = spark.createDataFrame([(0, "a")], "position int, candidate string")
    assert ev.leaderboard_from_folds(scores, pos).first()["fold_scores"] == [-54321.123456, -1234567.5]
    board = spark.createDataFrame([(0, "x", float("nan")), (1, "y", 0.9), (2, "z", None)], "position int, name string, score double")
    assert ev.best_candidate(board).first()["name"] == "y"
    assert ev.best_candidate(board.where("name <> 'y'")).count() == 0


def test_preprocessing_follows_the_training_side(spark):
    train = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, "b"), (8.0, None)], "x double, c string")
    new = spark.createDataFrame([(None, None), (3.0, "new"), (5.0, "a")], "x double, c string")
    prep = pp.Preprocessor.fit(train, pp.Columns(["x"], ["c"]))
    assert prep.medians == {"x": 3.0} and prep.modes == {"c": "b"}
    rows = prep.transform(new).select(pp.LINEAR, pp.TREE).collect()
    mean, std = 15 / 4, (sum((v - 15 / 4) ** 2 for v in (1, 3, 3, 8)) / 4) ** 0.5
    want = [([(3 - mean) / std, 0, 1], [3, 1]), ([(3 - mean) / std, 0, 0], [3, -1]), ([(5 - mean) / std, 1, 0], [5, 0])]
    got = sorted(([float(x) for x in r[0]], [float(x) for x in r[1]]) for r in rows)
    assert all(abs(a - b) < 1e-12 for g, w in zip(got, sorted(want)) for a, b in zip(g[0] + g[1], w[0] + w[1]))
    wide = pp.Preprocessor.fit(train, pp.Columns(["x"], ["c"]), one_hot_max=1).transform(new).first()
    assert len(wide[pp.LINEAR]) == 2  # beyond the bound a category enters by its code
    assert pp.split_columns(spark.createDataFrame([("t", 1)], "t string, n int").schema.fields, [], ["t"]).categorical == []


def test_fold_metrics_and_best(spark):
    oof = spark.createDataFrame(
        [("a", 0, 1.0, 1.0), ("a", 1, 2.0, 0.0), ("b", 0, 1.0, 1.0), ("b", 1, 0.0, 0.0)], "candidate string, fold int, label double, prediction double"
    )
    fs = {(r["candidate"], r["fold"]): r["score"] for r in ev.fold_metric(oof, "regression").collect()}
    assert fs[("a", 1)] == -2.0 and fs[("b", 0)] == 0.0
    pos = spark.createDataFrame([(0, "a"), (1, "b")], "position int, candidate string")
    board = ev.leaderboard_from_folds(ev.fold_metric(oof, "regression"), pos)
    assert [r["name"] for r in board.collect()] == ["b", "a"]
    tie = spark.createDataFrame([(0, "x", 0.5), (1, "y", 0.5)], "position int, name string, score double")
    assert ev.best_candidate(tie).first()["name"] == "x"  # first listed wins ties


def test_time_split_scheme_orders_by_parsed_text_dates(spark):
    # dates as text, rows given out of time order: validation folds must follow the parsed dates
    rows = [(i, f"2024-01-{(i * 7) % 28 + 1:02d}", float(i % 5), float((i * 7) % 28)) for i in range(1, 41)]
    train = spark.createDataFrame(rows, "id int, day string, x double, target double")
    res = ev.evaluate_candidates(train, None, None, target="target", key="id", candidates=["linear"], n_splits=3)
    assert res.validation_scheme == "time_split"
    oof = res.oof.collect()
    assert len(oof) == 30  # the first n - k*(n//(k+1)) = 10 rows get no OOF prediction


def test_group_kfold_scheme_keeps_groups_apart(spark):
    rows = [(i, i % 4, float(i % 5), float(i % 5) * 2.0) for i in range(40)]
    train = spark.createDataFrame(rows, "id int, grp int, x double, target double")
    res = ev.evaluate_candidates(train, None, None, target="target", key="id", validation_scheme="group_kfold",
                                 group_column="grp", candidates=["linear"], n_splits=2)
    assert res.validation_scheme == "group_kfold"
    folds = res.oof.join(train.select("id", "grp"), "id").groupBy("grp").agg(F.count_distinct("fold").alias("d")).collect()
    assert all(r["d"] == 1 for r in folds) and res.oof.count() == 40
