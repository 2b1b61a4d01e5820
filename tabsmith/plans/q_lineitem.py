"""Registered queries on lineitem, the largest table: the QA gate, the feature plan and
stratified folds at 6x the orders volume (the baseline's rows/s measurements)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import splits as sp
from ..operators.quality import qa_report
from ..operators.ranking import hash_key_sql
from ..sources.tables import table
from .registry import register

LKEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
_LK = ", ".join(LKEY)


def _line_id():
    return F.concat_ws("|", *[F.col(k).cast("string") for k in LKEY])


_LINE_ID_SQL = "concat_ws('|', " + ", ".join(f"cast({k} as string)" for k in LKEY) + ")"
_HOLD = f"substr(md5(cast(l_orderkey as string) || ':holdout'), 1, 1) in ('0', '1', '2')"


@register(
    "qa_report_lineitem",
    f"""
with s as (select {_LINE_ID_SQL} as line_id, l_extendedprice * 0.95 as l_price from lineitem),
st as (select count(*) as n, sum(case when line_id is null then 1 else 0 end) as nk,
              sum(case when l_price is null or isnan(l_price) then 1 else 0 end) as np,
              count(distinct line_id) as dk, min(l_price) as mn, max(l_price) as mx from s)
select 0 as check_order, 'row_count' as "check", cast(null as varchar) as "column", true as passed,
       'rows=' || cast(n as varchar) || ' expected=' || cast(n as varchar) as detail from st
union all select 1, 'not_empty', null, n > 0, 'rows=' || cast(n as varchar) from st
union all select 2, 'no_nulls', 'line_id', nk = 0, 'nulls=' || cast(nk as varchar) from st
union all select 2, 'no_nulls', 'l_price', np = 0, 'nulls=' || cast(np as varchar) from st
union all select 3, 'unique_id', 'line_id', n - dk - (case when nk > 0 then 1 else 0 end) = 0,
       'duplicates=' || cast(n - dk - (case when nk > 0 then 1 else 0 end) as varchar) from st
union all select 4, 'prediction_present', 'l_price', true, 'present'
union all select 5, 'type_family', 'l_price', np = 0, 'family=float bad=' || cast(np as varchar) from st
union all select 6, 'not_constant', null, not (n >= 20 and (np = n or (np = 0 and mn = mx))),
       'constant_columns=' || cast(case when np = n or (np = 0 and mn = mx) then 1 else 0 end as varchar) || ' min_rows=20' from st""",
)
def qa_report_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Q3 over every lineitem row: id = the composite line key, prediction = a price column."""
    li = table(spark, sf, "lineitem")
    sub = li.select(_line_id().alias("line_id"), (F.col("l_extendedprice") * 0.95).alias("l_price"))
    tmpl = li.select(_line_id().alias("line_id"), F.lit(0.5).alias("l_price"))
    test = li.select(_line_id().alias("line_id"), "l_quantity")
    return qa_report(sub, tmpl, test, expected_rows=None)


_COLS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate"
_FP_COLS = """t.l_orderkey, t.l_partkey, t.l_suppkey, t.l_linenumber, t.l_quantity, t.l_extendedprice, t.l_discount,
       t.l_returnflag, t.l_shipdate,
       cast(t.l_discount is null or isnan(t.l_discount) as integer) as l_discount__is_missing,
       cast(year(t.l_shipdate) as double) as l_shipdate__year, cast(month(t.l_shipdate) as double) as l_shipdate__month,
       cast(day(t.l_shipdate) as double) as l_shipdate__day,
       round(ln(1 + greatest(t.l_extendedprice, 0.0)), 9) as l_extendedprice__log1p,
       coalesce(fr.c, 0.0) as l_returnflag__freq, coalesce(fp.c, 0.0) as l_partkey__freq"""


@register(
    "feature_plan_lineitem",
    f"""
with tr as (select {_COLS} from lineitem where not ({_HOLD})),
te as (select {_COLS} from lineitem where {_HOLD}),
fr as (select coalesce(l_returnflag, 'nan') as v, cast(count(*) as double) as c from tr group by 1),
fp as (select cast(l_partkey as varchar) as v, cast(count(*) as double) as c from tr group by 1)
select 'train' as part, {_FP_COLS} from tr t left join fr on coalesce(t.l_returnflag, 'nan') = fr.v
  left join fp on cast(t.l_partkey as varchar) = fp.v
union all
select 'test', {_FP_COLS} from te t left join fr on coalesce(t.l_returnflag, 'nan') = fr.v
  left join fp on cast(t.l_partkey as varchar) = fp.v""",
)
def feature_plan_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """E0 on lineitem (hash holdout by order): indicators, date parts, log1p, two frequency encodings."""
    li = table(spark, sf, "lineitem").select(*[c.strip() for c in _COLS.split(",")])
    hold = F.expr(_HOLD)
    tr, te = li.where(~hold), li.where(hold)
    plan = fe.FeaturePlan.from_spec({
        "missing_indicators": ["l_discount"], "datetime_parts": ["l_shipdate"], "log1p_columns": ["l_extendedprice"],
        "frequency_encode": ["l_returnflag", "l_partkey"],
    })
    a, b = fe.apply_feature_plan(tr, te, plan)
    a = a.withColumn("l_extendedprice__log1p", F.round("l_extendedprice__log1p", 9))
    b = b.withColumn("l_extendedprice__log1p", F.round("l_extendedprice__log1p", 9))
    return a.select(F.lit("train").alias("part"), *a.columns).unionByName(b.select(F.lit("test").alias("part"), *b.columns))


@register(
    "stratified_kfold_lineitem",
    f"""
with c as (select l_returnflag, count(*) as n from lineitem group by l_returnflag),
co as (select l_returnflag,
              coalesce(sum(n) over (order by l_returnflag nulls first rows between unbounded preceding and 1 preceding), 0) as off
       from c),
r as (select {_LK}, l_returnflag,
             row_number() over (partition by l_returnflag order by {hash_key_sql(LKEY)}, {_LK}) as rn from lineitem)
select {_LK}, r.l_returnflag, cast((co.off + r.rn - 1) % 5 as integer) as fold
from r join co on r.l_returnflag is not distinct from co.l_returnflag""",
)
def stratified_kfold_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """W2 on lineitem: 5 folds stratified by l_returnflag over the composite line key."""
    df = table(spark, sf, "lineitem").select(*LKEY, "l_returnflag")
    return sp.stratified_kfold(df, "l_returnflag", LKEY, 5)
