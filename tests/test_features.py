"""Feature plan (FX-A4) and encoders."""

from tabsmith.operators import features as fe


def _fx_a4(spark):
    train = spark.createDataFrame(
        [(1, 10.0, "a", "2024-01-01", 0), (2, None, "b", "2024-02-03", 1), (3, 30.0, "a", "bad", 0)],
        "id int, amount double, category string, created_at string, target int",
    )
    test = spark.createDataFrame([(4, None, "c", "2024-03-04"), (5, 5.0, "a", "2024-04-05")], "id int, amount double, category string, created_at string")
    return train, test


def test_feature_plan_columns_and_values(spark):
    train, test = _fx_a4(spark)
    plan = fe.FeaturePlan.from_spec({
        "missing_indicators": ["amount"], "datetime_parts": ["created_at"], "log1p_columns": ["amount"],
        "frequency_encode": ["category"], "transforms_applied": ["x"], "other": 1,
    })
    tr, te = fe.apply_feature_plan(train, test, plan, "target")
    for c in ["amount__is_missing", "created_at__year", "created_at__month", "created_at__day", "amount__log1p", "category__freq"]:
        assert c in tr.columns and c in te.columns
    assert tr.columns[-1] == "category__freq" and "target" in tr.columns
    r = {x["id"]: x for x in te.collect()}
    assert r[4]["amount__is_missing"] == 1 and r[4]["amount__log1p"] is None
    assert r[4]["category__freq"] == 0.0 and r[5]["category__freq"] == 2.0  # unseen -> 0
    t = {x["id"]: x for x in tr.collect()}
    assert t[3]["created_at__year"] is None and t[2]["created_at__month"] == 2.0
    assert plan.transforms_applied == ["x"]


def test_median_mode_and_scaling(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3]] + [(None,), (float("nan"),)], "v double")
    assert fe.exact_median(df, "v").first()["median"] == 1.5
    s = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert fe.most_frequent(s, "c").first()["value"] == "a"  # tie -> smallest
    st = fe.mean_std(spark.createDataFrame([(1.0,), (3.0,)], "v double"), ["v"]).first()
    assert st["mean"] == 2.0 and st["std_pop"] == 1.0


def test_ordinal_unknown_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, c string")
    idx = fe.category_index(train, "c")
    got = {r["id"]: r["c__ord"] for r in fe.ordinal_encode(test, "c", idx).collect()}
    assert got == {1: 0, 2: -1, 3: -1}


def test_counts_of_few_values_are_broadcast(spark):
    rows = [(i, "AB"[i % 2] if i % 5 else None, f"k{i}") for i in range(100)]
    train = spark.createDataFrame(rows, "id int, flag string, key string")
    assert fe.few_values(train, ["flag", "key"]) == {"flag", "key"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, _ = fe.apply_feature_plan(train, None, fe.FeaturePlan(frequency_encode=["flag"]))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the rows are not shuffled by their flag
    assert {(r.flag, r.flag__freq) for r in got.collect()} == {("A", 40.0), ("B", 40.0), (None, 20.0)}
    long = spark.createDataFrame([("x" * 3_000_000,), ("y",)], "flag string")
    assert fe.few_values(long, ["flag"]) == set()
