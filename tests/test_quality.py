"""Prediction-table repair and quality gate (FX-B1..B5)."""

import pytest

from tabsmith.operators import conform as cf
from tabsmith.operators import schema as sc
from tabsmith.operators.quality import assert_quality, qa_report


def _fails(spark, sub, tmpl, test, check):
    rep = {(r["check"], r["column"]): r["passed"] for r in qa_report(sub, tmpl, test).collect()}
    failed = [k for k, v in rep.items() if not v]
    assert any(k[0] == check for k in failed), rep
    with pytest.raises(ValueError, match=check):
        assert_quality(qa_report(sub, tmpl, test))


def test_prediction_columns_rule():
    assert sc.prediction_columns(["id", "target"], ["id", "feature"]) == ["target"]
    assert sc.prediction_columns(["id", "a", "b"], None) == ["a", "b"]
    assert sc.prediction_columns(["only"], None) == ["only"]


def test_rename_and_restore_by_key(spark):
    sample = spark.createDataFrame([(1, 0, "x"), (2, 1, "y")], "id int, prediction int, Comment string")
    test = spark.createDataFrame([(1, 5), (2, 6)], "id int, feature int")
    sub = spark.createDataFrame([(2, 1), (1, 0)], "id int, pred int")
    res = cf.conform(sub, sample, test)
    assert res.renamed == {} and res.frame.columns == ["id", "prediction", "Comment"]
    # sample-only columns: prediction, Comment -> two missing predictions, one extra: no rename
    sub2 = spark.createDataFrame([(1, 0, "x"), (2, 1, "y")], "id int, guess int, Comment string")
    res2 = cf.conform(sub2, sample, test)
    assert res2.renamed == {"guess": "prediction"}
    assert res2.frame.columns == ["id", "prediction", "Comment"]


def test_restore_id_positionally(spark):
    # FX-B1 / FX-B4: the submission has only the prediction; the id comes from test by position
    sample = spark.createDataFrame([(10, 0), (20, 0)], "id int, target int")
    test = spark.createDataFrame([(10, 1.0), (20, 2.0)], "id int, feature double")
    sub = spark.createDataFrame([(0, 1), (1, 0)], "row int, prediction int")
    res = cf.conform(sub, sample, test, order_by={"submission": ["row"], "test": ["id"], "template": ["id"]})
    got = sorted(tuple(r) for r in res.frame.collect())
    assert res.renamed == {"prediction": "target"}
    assert got == [(10, 1), (20, 0)]


def test_gate_rejections(spark):
    tmpl = spark.createDataFrame([(1, 0), (2, 0)], "id int, prediction int")
    test = spark.createDataFrame([(1,), (2,)], "id int")
    _fails(spark, spark.createDataFrame([(1, 0)], "id int, prediction int"), tmpl, test, "row_count")
    _fails(spark, spark.createDataFrame([(1, 0), (2, None)], "id int, prediction int"), tmpl, test, "no_nulls")
    _fails(spark, spark.createDataFrame([(1, 0), (1, 1)], "id int, prediction int"), tmpl, test, "unique_id")
    _fails(spark, spark.createDataFrame([(1, 0.5), (2, 1.0)], "id int, prediction double"), tmpl, test, "type_family")
    _fails(spark, spark.createDataFrame([(1,), (2,)], "id int"), tmpl, test, "prediction_present")
    ok = spark.createDataFrame([(1, 0), (2, 1)], "id int, prediction int")
    assert_quality(qa_report(ok, tmpl, test))


def test_constant_predictions_rejected_at_20_rows(spark):
    tmpl = spark.createDataFrame([(i, 0) for i in range(25)], "id int, prediction int")
    test = spark.createDataFrame([(i,) for i in range(25)], "id int")
    const = spark.createDataFrame([(i, 1) for i in range(25)], "id int, prediction int")
    _fails(spark, const, tmpl, test, "not_constant")
    small = spark.createDataFrame([(1, 1), (2, 1)], "id int, prediction int")
    assert_quality(qa_report(small, spark.createDataFrame([(1, 0), (2, 0)], "id int, prediction int"),
                             spark.createDataFrame([(1,), (2,)], "id int")))


def test_type_family_cells(spark):
    # FX-B5: boolean-like, float and integer families
    tb = spark.createDataFrame([(1, True), (2, False)], "id int, p boolean")
    t = spark.createDataFrame([(1,), (2,)], "id int")
    assert_quality(qa_report(spark.createDataFrame([(1, "true"), (2, "0")], "id int, p string"), tb, t))
    _fails(spark, spark.createDataFrame([(1, "maybe"), (2, "0")], "id int, p string"), tb, t, "type_family")
    tf = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id int, p double")
    _fails(spark, spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string"), tf, t, "type_family")
    _fails(spark, spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id int, p double"), tf, t, "no_nulls")
    ti = spark.createDataFrame([(1, 0), (2, 0)], "id int, p int")
    assert_quality(qa_report(spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, p double"), ti, t))
    _fails(spark, spark.createDataFrame([(1, float("inf")), (2, 2.0)], "id int, p double"), ti, t, "type_family")


def test_normalize_and_repair(spark):
    tmpl = spark.createDataFrame([(1, 0), (2, 0)], "id int, target int")
    test = spark.createDataFrame([(1, 3), (2, 4)], "id int, feature int")
    sub = spark.createDataFrame([(2, 1), (1, 0)], "id int, target int")
    out = cf.normalize(sub, tmpl, test)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0), (2, 1)]
    with pytest.raises(ValueError, match="row count"):
        cf.normalize(spark.createDataFrame([(1, 0)], "id int, target int"), tmpl, test)
    # repair never raises: a wrong-size submission comes back unchanged
    bad = spark.createDataFrame([(1, 0)], "id int, target int")
    assert cf.repair(bad, tmpl, test) is bad


def test_choose_candidate_and_fill_template(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id int, p double")
    b = spark.createDataFrame([(1, 0.1)], "id int, p double")
    got = cf.choose_candidate({"submission.csv": a, "zeta": a, "result_df": a, "b": b}, 2).collect()
    assert got[0]["name"] == "result_df"
    tmpl = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id int, p double")
    filled = cf.fill_template(tmpl, a.withColumnRenamed("p", "v"), "id", "v")
    assert sorted(tuple(r) for r in filled.collect()) == [(1, 0.1), (2, 0.2)]


def test_boolean_submission_counts_as_numeric(spark):
    tmpl = spark.createDataFrame([(1, 0), (2, 0)], "id int, p int")
    t = spark.createDataFrame([(1,), (2,)], "id int")
    assert_quality(qa_report(spark.createDataFrame([(1, True), (2, False)], "id int, p boolean"), tmpl, t))
