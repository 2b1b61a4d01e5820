"""Fold and sample invariants; results must not depend on partitioning."""

from pyspark.sql import functions as F

from tabsmith.operators import sampling as sm
from tabsmith.operators import splits as sp
from tabsmith.operators.ranking import hash_rank, ordinal


def _frame(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("cls"), (F.col("id") % 7).alias("g"))


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_partition_count_invariance(spark):
    base = _frame(spark)
    ref = _rows(hash_rank(base, ["k"], within=["cls"]), ["k", "rank"])
    for n in (1, 4, 17):
        assert _rows(hash_rank(base.repartition(n), ["k"], within=["cls"]), ["k", "rank"]) == ref
    ords = _rows(ordinal(base.repartition(17), ["g", "k"]), ["k", "ordinal"])
    assert sorted(o for _, o in ords) == list(range(1000))
    assert ords == _rows(ordinal(base.repartition(3), ["g", "k"]), ["k", "ordinal"])


def test_stratified_kfold_balance(spark):
    df = sp.stratified_kfold(_frame(spark), "cls", ["k"], 3)
    sizes = [r["n"] for r in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1000
    per = df.groupBy("cls", "fold").agg(F.count(F.lit(1)).alias("n")).groupBy("cls").agg((F.max("n") - F.min("n")).alias("d"))
    assert all(r["d"] <= 1 for r in per.collect())
    assert df.select("k").distinct().count() == 1000  # each key in exactly one fold


def test_null_class_is_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a") for i in range(40)], "k int, cls string")
    out = sp.stratified_kfold(df, "cls", ["k"], 2)
    assert out.count() == 40 and out.where(F.col("cls").isNull()).count() == 10


def test_kfold_and_group_kfold(spark):
    df = _frame(spark)
    sizes = [r[1] for r in sp.kfold(df, ["k"], 4).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    g = sp.group_kfold(df, "g", 3)
    assert g.groupBy("g").agg(F.count_distinct("fold").alias("d")).where("d > 1").count() == 0


def test_time_split_shape(spark):
    df = _frame(spark, 100)
    out = sp.time_split(df, ["k"], 3)
    # m = 100 // 4 = 25: first 25 rows in no fold, then 25 per fold in order
    got = {r["fold"]: (r["lo"], r["hi"], r["n"]) for r in out.groupBy("fold").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    assert got[None] == (0, 24, 25) and got[0] == (25, 49, 25) and got[2] == (75, 99, 25)


def test_stratified_subsample_keeps_classes_and_caps(spark):
    # FX-A7 shape: 250,000 balanced rows -> large -> at most 120,000, both classes kept
    df = spark.range(250_000).select(F.col("id").alias("feature"), (F.col("id") % 5).alias("other"), (F.col("id") % 2).alias("target"))
    out, used, n = sm.subsample_for_eval(df, "target", ["feature"], True)
    assert used and n == 250_000
    counts = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert sum(counts.values()) == 120_000 and set(counts) == {0, 1}


def test_no_subsample_when_small(spark):
    df = _frame(spark)
    out, used, _ = sm.subsample_for_eval(df, "cls", ["k"], True)
    assert not used and out is df
    assert sm.is_large(200_000, 1) and sm.is_large(1000, 5000) and not sm.is_large(1000, 10)


def test_random_subsample_exact(spark):
    out = sm.random_subsample(_frame(spark), ["k"], 123)
    assert out.count() == 123 and out.select("k").distinct().count() == 123


def test_hot_class_is_spread_over_buckets(spark):
    # one class holds a third of all rows: ranks stay exact and the window is keyed by (class, bucket)
    n = 30_000
    df = spark.range(n).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("cls")
    )
    out = sp.stratified_kfold(df, "cls", ["k"], 3)
    hot = out.where(F.col("cls") == "hot").groupBy("fold").count().collect()
    sizes = sorted(r["count"] for r in hot)
    assert sum(sizes) == n // 3 and sizes[-1] - sizes[0] <= 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cls" in plan and "_hb" in plan
    ranks = hash_rank(df, ["k"], within=["cls"]).where(F.col("cls") == "hot").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(ranks) == (1, n // 3, n // 3)


def test_terminal_guard_with_hot_user(spark):
    from tabsmith.streaming.context import terminal_guard

    rows = [(i, i, 1 if i % 2 == 0 else i, "error" if i == 10 else "view") for i in range(200)]
    ev = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string")
    got = {r["event_id"]: r["rejected"] for r in terminal_guard(ev).collect()}
    assert got[10] is False and got[12] is True and got[8] is False and got[11] is False
