"""Registered queries: feature plan and encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aliases import CANDIDATE_ALIASES, alias_column
from ..functions.exprs import clamp, date_parts, lenient_double, log1p_clipped, missing_indicator
from ..operators import features as fe
from ..operators import sampling as sm
from ..operators.quality import q
from ..sources.tables import fixture, table, with_views
from .registry import register

_FREQ_SQL = """
, fr as (select coalesce(event_type, 'nan') as v, cast(count(*) as double) as c from v_events_train group by 1)"""


@register(
    "missing_indicators",
    with_views(
        """
select event_id, cast(value is null or isnan(value) as integer) as value__is_missing,
       cast(event_type is null as integer) as event_type__is_missing from v_events""",
        "v_events",
    ),
)
def missing_indicators_query(spark: SparkSession, sf: str) -> DataFrame:
    """0/1 NULL/NaN indicators."""
    df = fixture(spark, sf, "v_events")
    return df.select(
        "event_id",
        missing_indicator(q("value"), df.schema["value"].dataType).alias("value__is_missing"),
        missing_indicator(q("event_type"), df.schema["event_type"].dataType).alias("event_type__is_missing"),
    )


@register(
    "datetime_parts",
    with_views(
        """
select event_id, cast(year(try_cast(ts_text as timestamp)) as double) as ts_text__year,
       cast(month(try_cast(ts_text as timestamp)) as double) as ts_text__month,
       cast(day(try_cast(ts_text as timestamp)) as double) as ts_text__day from v_events""",
        "v_events",
    ),
)
def datetime_parts_query(spark: SparkSession, sf: str) -> DataFrame:
    """lenient parse of a text timestamp, then year/month/day (bad -> NULL)."""
    df = fixture(spark, sf, "v_events")
    parts = date_parts(q("ts_text"), "ts_text", df.schema["ts_text"].dataType)
    return df.select("event_id", *[c.alias(n) for n, c in parts.items()])


@register(
    "log1p_columns",
    with_views(
        """
select event_id, value, case when value is not null then round(ln(1 + greatest(value, 0.0)), 9) end as value__log1p,
       case when try_cast(props as double) is not null then round(ln(1 + greatest(try_cast(props as double), 0.0)), 9) end as props__log1p from v_events""",
        "v_events",
    ),
)
def log1p_columns_query(spark: SparkSession, sf: str) -> DataFrame:
    """lenient numeric parse, clip at 0, log1p; NULL stays NULL."""
    df = fixture(spark, sf, "v_events")
    props = lenient_double(q("props"), df.schema["props"].dataType)
    return df.select(
        "event_id",
        "value",
        F.round(log1p_clipped(q("value")), 9).alias("value__log1p"),
        F.round(log1p_clipped(props), 9).alias("props__log1p"),
    )


@register(
    "frequency_encode",
    with_views(
        _FREQ_SQL
        + """
select 'train' as part, t.event_id, coalesce(fr.c, 0.0) as event_type__freq
from v_events_train t left join fr on coalesce(t.event_type, 'nan') = fr.v
union all
select 'test', t.event_id, coalesce(fr.c, 0.0)
from v_events_test t left join fr on coalesce(t.event_type, 'nan') = fr.v""",
        "v_events_train",
        "v_events_test",
    ),
)
def frequency_encode_query(spark: SparkSession, sf: str) -> DataFrame:
    """Training counts of the string form (NULL -> 'nan') mapped onto train and test; unseen -> 0."""
    train = fixture(spark, sf, "v_events_train")
    test = fixture(spark, sf, "v_events_test")
    freq = fe.frequency_table(train, "event_type")
    a = fe.apply_frequency(train, "event_type", freq).select(F.lit("train").alias("part"), "event_id", "event_type__freq")
    b = fe.apply_frequency(test, "event_type", freq).select(F.lit("test").alias("part"), "event_id", "event_type__freq")
    return a.unionByName(b)


_PLAN = {
    "missing_indicators": ["value", "not_a_column"],
    "datetime_parts": ["ts_text"],
    "log1p_columns": ["value"],
    "frequency_encode": ["event_type", "user_id"],
    "transforms_applied": ["missing", "dates", "log1p", "freq"],
    "unknown_key": ["ignored"],
}
_PLAN_COLS = """t.event_id, t.user_id, t.ts_text, t.value, t.event_type, t.props,
       cast(t.value is null or isnan(t.value) as integer) as value__is_missing,
       cast(year(try_cast(t.ts_text as timestamp)) as double) as ts_text__year,
       cast(month(try_cast(t.ts_text as timestamp)) as double) as ts_text__month,
       cast(day(try_cast(t.ts_text as timestamp)) as double) as ts_text__day,
       case when t.value is not null then round(ln(1 + greatest(t.value, 0.0)), 9) end as value__log1p,
       coalesce(fe.c, 0.0) as event_type__freq, coalesce(fu.c, 0.0) as user_id__freq"""


@register(
    "feature_plan",
    with_views(
        _FREQ_SQL.replace("fr as", "fe as")
        + """
, fu as (select cast(user_id as varchar) as v, cast(count(*) as double) as c from v_events_train group by 1)
select 'train' as part, """
        + _PLAN_COLS
        + """
from v_events_train t left join fe on coalesce(t.event_type, 'nan') = fe.v left join fu on cast(t.user_id as varchar) = fu.v
union all
select 'test', """
        + _PLAN_COLS
        + """
from v_events_test t left join fe on coalesce(t.event_type, 'nan') = fe.v left join fu on cast(t.user_id as varchar) = fu.v""",
        "v_events_train",
        "v_events_test",
    ),
)
def feature_plan_query(spark: SparkSession, sf: str) -> DataFrame:
    """The full plan on events train/test (absent columns and unknown keys ignored)."""
    train = fixture(spark, sf, "v_events_train")
    test = fixture(spark, sf, "v_events_test")
    tr, te = fe.apply_feature_plan(train, test, fe.FeaturePlan.from_spec(_PLAN), target=None)
    tr = tr.withColumn("value__log1p", F.round("value__log1p", 9))
    te = te.withColumn("value__log1p", F.round("value__log1p", 9))
    return tr.select(F.lit("train").alias("part"), *tr.columns).unionByName(te.select(F.lit("test").alias("part"), *te.columns))


@register(
    "impute_median",
    with_views("select median(value) as median from v_events where value is not null and not isnan(value)", "v_events"),
)
def impute_median_query(spark: SparkSession, sf: str) -> DataFrame:
    """Exact median by distributed selection (mean of the middle two)."""
    return fe.exact_median(fixture(spark, sf, "v_events"), "value")


@register(
    "impute_mode",
    with_views(
        """
select value, rows from (
  select event_type as value, count(*) as rows,
         row_number() over (order by count(*) desc, event_type) as rn
  from v_events where event_type is not null group by event_type) where rn = 1""",
        "v_events",
    ),
)
def impute_mode_query(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent value, ties -> smallest."""
    return fe.most_frequent(fixture(spark, sf, "v_events"), "event_type")


@register(
    "standardize",
    with_views(
        """
select 'value' as "column", round(avg(value), 9) as mean, round(stddev_pop(value), 9) as std_pop from v_events
union all select 'user_id', round(avg(user_id), 9), round(stddev_pop(user_id), 9) from v_events""",
        "v_events",
    ),
)
def standardize_query(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population std (Spark ML's scaler uses the sample std)."""
    s = fe.mean_std(fixture(spark, sf, "v_events"), ["value", "user_id"])
    return s.select("column", F.round("mean", 9).alias("mean"), F.round("std_pop", 9).alias("std_pop"))


@register(
    "ordinal_encode",
    with_views(
        """
with idx as (select v, cast(row_number() over (order by v) - 1 as integer) as code
             from (select distinct event_type as v from v_events_train where event_type is not null))
select t.event_id, coalesce(idx.code, -1) as event_type__ord from v_events_test t left join idx on t.event_type = idx.v""",
        "v_events_train",
        "v_events_test",
    ).replace("\nwith idx as", ",\nidx as", 1),
)
def ordinal_encode_query(spark: SparkSession, sf: str) -> DataFrame:
    """E5: codes fitted on train, applied to test; unknown or missing -> -1."""
    train = fixture(spark, sf, "v_events_train")
    test = fixture(spark, sf, "v_events_test")
    idx = fe.category_index(train, "event_type")
    return fe.ordinal_encode(test, "event_type", idx).select("event_id", "event_type__ord")


@register(
    "one_hot",
    """
with idx as (select v, cast(row_number() over (order by v) - 1 as integer) as code
             from (select distinct c_mktsegment as v from customer))
select c.c_custkey, idx.code as c_mktsegment__slot, cast(1.0 as double) as value
from customer c left join idx on c.c_mktsegment = idx.v""",
)
def one_hot_query(spark: SparkSession, sf: str) -> DataFrame:
    """E4 in sparse (key, slot, value) form: every known category keeps its own slot;
    unknown and NULL values have no active slot (all zeros).

    The relational form never materialises a dense row of width #categories; the
    model presets use ``StringIndexer`` + ``OneHotEncoder(dropLast)`` with the same slots.
    """
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    idx = fe.category_index(df, "c_mktsegment")
    out = fe.one_hot_slots(df, "c_mktsegment", idx)
    return out.select("c_custkey", "c_mktsegment__slot", F.when(F.col("c_mktsegment__slot").isNotNull(), F.lit(1.0)).alias("value"))


# ---------------------------------------------------------------- F16, F17, L6, P8, E1-E3 applied
_SPELLINGS = sorted(CANDIDATE_ALIASES)
_ALIAS_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in sorted(CANDIDATE_ALIASES.items()))
_SPELLED = "case cast(l_orderkey % {n} as integer) " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_SPELLINGS)) + " else 'other' end"


@register(
    "alias_map",
    f"select l_orderkey, l_linenumber, case x {_ALIAS_CASES} else x end as candidate from "
    f"(select l_orderkey, l_linenumber, {_SPELLED.format(n=len(_SPELLINGS) + 1)} as x from lineitem)",
)
def alias_map(spark: SparkSession, sf: str) -> DataFrame:
    """F16: a column of spellings becomes canonical names; unknown ones pass through."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_SPELLED.format(n=len(_SPELLINGS) + 1)).alias("x"))
    return li.select("l_orderkey", "l_linenumber", alias_column("x").alias("candidate"))


@register("clamp", "select o_orderkey, greatest(1000.0, least(o_totalprice, 200000.0)) as price from orders")
def clamp_query(spark: SparkSession, sf: str) -> DataFrame:
    """values outside the range take its ends."""
    return table(spark, sf, "orders").select("o_orderkey", clamp("o_totalprice", 1000.0, 200000.0).alias("price"))


@register(
    "subsample_rule",
    """
select 'default rule' as rule, count(*) as rows_before, count(*) >= 200000 or count(*) * 6 >= 5000000 as used, count(*) as rows_after from orders
  having not (count(*) >= 200000 or count(*) * 6 >= 5000000) or count(*) <= 120000
union all
select 'small rule', count(*), true, least(100, count(*)) from orders""",
)
def subsample_rule(spark: SparkSession, sf: str) -> DataFrame:
    """The size rule decides whether a sample is taken; with the rule's own limits a small one, taken exactly."""
    df = table(spark, sf, "orders")
    parts = []
    for name, rule in (("default rule", sm.SizeRule()), ("small rule", sm.SizeRule(large_rows=200, sample_rows=100))):
        out, used, before = sm.subsample_for_eval(df, "o_totalprice", ["o_orderkey"], False, rule)
        parts.append(
            out.agg(F.count(F.lit(1)).alias("rows_after")).select(
                F.lit(name).alias("rule"), F.lit(before).cast("long").alias("rows_before"), F.lit(used).alias("used"), "rows_after"
            )
        )
    return parts[0].unionByName(parts[1])


@register(
    "feature_plan_target",
    "select c_custkey, c_acctbal, ln(1 + greatest(c_nationkey, 0)) as c_nationkey__log1p from customer",
)
def feature_plan_target(spark: SparkSession, sf: str) -> DataFrame:
    """A plan that names the target leaves it as it is and adds nothing for it."""
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    plan = fe.FeaturePlan(log1p_columns=["c_acctbal", "c_nationkey"], frequency_encode=["c_acctbal"], missing_indicators=["c_acctbal"])
    out, _ = fe.apply_feature_plan(df, None, plan, "c_acctbal")
    return out.drop("c_nationkey")


@register(
    "impute_applied",
    """
with t as (select c_custkey, case when c_custkey % 4 <> 0 then c_acctbal end as balance, case when c_custkey % 3 <> 0 then c_mktsegment end as segment
           from customer),
m as (select median(balance) as med from t),
s as (select segment as seg from t where segment is not null group by segment order by count(*) desc, segment limit 1),
x as (select avg(coalesce(balance, med)) as mean, stddev_pop(coalesce(balance, med)) as std from t cross join m)
select c_custkey, round((coalesce(balance, med) - mean) / std, 6) as balance, coalesce(segment, seg) as segment
from t cross join m cross join s cross join x""",
)
def impute_applied(spark: SparkSession, sf: str) -> DataFrame:
    """E1-E3 applied: median and most frequent value filled in, then scaled."""
    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"),
    )
    values = {"balance": fe.exact_medians(df, ["balance"])["balance"], "segment": fe.most_frequent(df, "segment").first()["value"]}
    filled = fe.fill_missing(df, values)
    stats = {r["column"]: (r["mean"], r["std_pop"]) for r in fe.mean_std(filled, ["balance"]).collect()}
    return fe.standardize(filled, stats).select("c_custkey", F.round("balance", 6).alias("balance"), "segment")
