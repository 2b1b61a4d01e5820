"""Task inference rules on small in-test frames (FX-A1..A3, A9)."""

from tabsmith.operators import schema as sc
from tabsmith.operators.profile import feature_summary, preview, table_profile
from tabsmith.plans import task as tk


def _fx_a1(spark):
    train = spark.createDataFrame(
        [(1, "short", True, "2024-01-01", 0), (2, "another short", False, "2024-01-02", 1), (3, "long enough text here", True, "2024-01-03", 0)],
        "id int, text string, flag boolean, when string, target int",
    )
    test = spark.createDataFrame([(4, "held out", "2024-01-04"), (5, "another", "2024-01-05")], "id int, text string, when string")
    sample = spark.createDataFrame([(4, 0), (5, 0)], "id int, prediction int")
    return train, test, sample


def test_target_and_id_candidates(spark):
    train, test, sample = _fx_a1(spark)
    assert sc.target_candidates(train.columns, test.columns, sample.columns) == ["prediction"]
    assert sc.target_candidates(train.columns, test.columns, None) == ["flag", "target"]
    assert sc.target_candidates(train.columns, None, None) == ["target"]
    assert sc.id_candidates(train.columns, test.columns, sample.columns)[0] == "id"


def test_feature_summary_flags(spark):
    train, _, _ = _fx_a1(spark)
    fs = feature_summary(train, ["id", "target"], ["id"])
    assert "flag" in fs.numeric_columns
    assert "text" in fs.categorical_columns
    assert "when" in fs.datetime_columns
    assert fs.text_heavy is False
    assert fs.datetime_heavy is True
    assert fs.column_count == 3


def test_task_type_rules(spark):
    s = lambda rows, t: spark.createDataFrame([(r,) for r in rows], f"y {t}")
    assert tk.infer_task_type(s(["a", "b", "a"], "string"), "y") == tk.BINARY
    assert tk.infer_task_type(s([0, 1, 2], "int"), "y") == tk.MULTICLASS
    assert tk.infer_task_type(s([0.1, 0.2, 0.3], "double"), "y") == tk.REGRESSION
    assert tk.infer_task_type(s([True, False], "boolean"), "y") == tk.BINARY
    assert tk.infer_task_type(s(list(range(21)), "int"), "y") == tk.REGRESSION
    # An integer target with a NULL is regression (pandas reads it as float)
    assert tk.infer_task_type(s([0, 1, None], "int"), "y") == tk.REGRESSION


def test_recommended_validation():
    assert tk.recommended_validation(tk.BINARY, True, []) == "time_split"
    assert tk.recommended_validation(tk.REGRESSION, False, ["id"]) == "grouped_kfold_recommended"
    assert tk.recommended_validation(tk.BINARY, False, []) == "stratified_kfold"
    assert tk.recommended_validation(tk.REGRESSION, False, []) == "kfold"
    assert tk.metric_family(tk.MULTICLASS) == "accuracy"
    assert tk.metric_family(tk.REGRESSION) == "neg_rmse"


def test_default_candidates():
    assert tk.default_candidates(tk.REGRESSION, True) == ["linear_regression", "lightgbm_regressor"]
    assert tk.default_candidates(tk.BINARY, True)[0] == "tfidf_linear"
    assert tk.default_candidates(tk.BINARY, False) == ["logistic_regression", "lightgbm_classifier"]


def test_infer_task_binary_and_text(spark):
    train = spark.createDataFrame([(1, 1.5, "a", 0), (2, 2.5, "b", 1), (3, 3.5, "a", 0)], "id int, num double, cat string, target int")
    test = spark.createDataFrame([(4, 4.5, "b"), (5, 5.5, "a")], "id int, num double, cat string")
    sample = spark.createDataFrame([(4, 0), (5, 0)], "id int, target int")
    r = tk.infer_task(train, test, sample)
    assert r.task_type == tk.BINARY and r.target == "target" and r.id_candidates == ["id"]
    assert r.features.numeric_columns == ["num"] and r.validation == "grouped_kfold_recommended"
    long = "this is a rather long piece of text"
    train = spark.createDataFrame([(1, long, 0), (2, long + " two", 1), (3, long + " three", 0)], "id int, text string, target int")
    test = spark.createDataFrame([(4, long), (5, long)], "id int, text string")
    r = tk.infer_task(train, test, sample)
    assert r.features.text_heavy and r.features.text_columns == ["text"]


def test_infer_task_template_only_target_falls_back(spark):
    # A template-only target name is not in train: fall back to train-only columns
    train, test, sample = _fx_a1(spark)
    r = tk.infer_task(train, test, sample)
    assert r.target_candidates == ["prediction"] and r.target == "flag"


def test_profile_and_preview(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "feature int, target int")
    prof = {r["column"]: r for r in table_profile(df).collect()}
    assert prof["feature"]["rows"] == 2 and prof["feature"]["nulls"] == 0 and prof["feature"]["max_num"] == 2.0
    rows = preview(df, ["feature"], 1).collect()
    assert [tuple(r) for r in rows] == [(1, 0)]
    assert preview(df, ["feature"], 99).count() == 2  # clamped to 20 at most


def test_label_index_numeric_order(spark):
    df = spark.createDataFrame([(9,), (10,), (9,), (2,)], "y int")
    got = [(r["label"], r["label_index"]) for r in tk.label_index(df, "y").orderBy("label_index").collect()]
    assert got == [(2, 0), (9, 1), (10, 2)]  # numeric order, not "10" < "9"
