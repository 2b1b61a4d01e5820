"""Registered queries: ordinals, folds and exact samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as sm
from ..operators import splits as sp
from ..operators.ranking import hash_key_sql
from ..sources.tables import table
from .registry import register

LKEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
_LK = ", ".join(LKEY)
# Sample size of the sampling queries (the operator's N; the reference default is 120,000).
SAMPLE_ROWS = 6000


@register(
    "row_ordinal",
    f"select {_LK}, row_number() over (order by {_LK}) - 1 as ordinal from lineitem",
)
def row_ordinal_query(spark: SparkSession, sf: str) -> DataFrame:
    """Dense ordinal of lineitem in key order (range sort + partition offsets)."""
    return sp.row_ordinal(table(spark, sf, "lineitem").select(*LKEY), LKEY)


@register(
    "stratified_kfold",
    f"""
with c as (select o_orderstatus, count(*) as n from orders group by o_orderstatus),
co as (select o_orderstatus,
              coalesce(sum(n) over (order by o_orderstatus nulls first rows between unbounded preceding and 1 preceding), 0) as off
       from c),
r as (select o_orderkey, o_orderstatus,
             row_number() over (partition by o_orderstatus order by {hash_key_sql(['o_orderkey'])}, o_orderkey) as rn
      from orders)
select r.o_orderkey, r.o_orderstatus, cast((co.off + r.rn - 1) % 3 as integer) as fold
from r join co on r.o_orderstatus is not distinct from co.o_orderstatus""",
)
def stratified_kfold_query(spark: SparkSession, sf: str) -> DataFrame:
    """3 stratified folds of orders by o_orderstatus, seed 42."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sp.stratified_kfold(df, "o_orderstatus", ["o_orderkey"], 3)


@register(
    "kfold",
    f"""
select {_LK}, cast((row_number() over (order by {hash_key_sql(LKEY)}, {_LK}) - 1) % 3 as integer) as fold
from lineitem""",
)
def kfold_query(spark: SparkSession, sf: str) -> DataFrame:
    """3 shuffled folds of lineitem (composite key), seed 42."""
    return sp.kfold(table(spark, sf, "lineitem").select(*LKEY), LKEY, 3)


@register(
    "time_split",
    """
with o as (select event_id, row_number() over (order by ts, event_id) - 1 as ordinal, count(*) over () as n from events)
select event_id, ordinal,
       case when ordinal >= n - 3 * (n // 4) then cast(floor((ordinal - (n - 3 * (n // 4))) / (n // 4)) as integer) end as fold
from o""",
)
def time_split_query(spark: SparkSession, sf: str) -> DataFrame:
    """Expanding time split of events by (ts, event_id), k = 3."""
    df = table(spark, sf, "events").select("event_id", "ts")
    return sp.time_split(df, ["ts", "event_id"], 3).drop("ts")


@register(
    "group_kfold",
    f"""
with g as (select user_id, cast((row_number() over (order by {hash_key_sql(['user_id'])}, user_id) - 1) % 3 as integer) as fold
           from (select distinct user_id from events))
select e.event_id, e.user_id, g.fold from events e join g on e.user_id = g.user_id""",
)
def group_kfold_query(spark: SparkSession, sf: str) -> DataFrame:
    """3 folds over users, so no user is on both sides."""
    return sp.group_kfold(table(spark, sf, "events").select("event_id", "user_id"), "user_id", 3)


_QUOTA_SQL = f"""
with c as (select l_returnflag, count(*) as class_rows from lineitem group by l_returnflag),
q as (select l_returnflag, class_rows,
             least(greatest(1, cast(round_even(class_rows / sum(class_rows) over () * {SAMPLE_ROWS}, 0) as bigint)), class_rows) as quota
      from c)"""


@register("class_quota", _QUOTA_SQL + "\nselect l_returnflag, class_rows, quota from q")
def class_quota_query(spark: SparkSession, sf: str) -> DataFrame:
    """Per-class proportional quota, half-even rounding, at least 1."""
    return sm.class_quota(table(spark, sf, "lineitem"), "l_returnflag", SAMPLE_ROWS)


@register(
    "stratified_subsample",
    _QUOTA_SQL
    + f""",
r as (select {_LK}, l_returnflag,
             row_number() over (partition by l_returnflag order by {hash_key_sql(LKEY)}, {_LK}) as rn from lineitem),
k as (select r.* from r join q on r.l_returnflag is not distinct from q.l_returnflag where r.rn <= q.quota),
g as (select *, row_number() over (order by {hash_key_sql(LKEY)}, {_LK}) as grn from k)
select {_LK}, l_returnflag from g where grn <= {SAMPLE_ROWS}""",
)
def stratified_subsample_query(spark: SparkSession, sf: str) -> DataFrame:
    """W5 + L4: stratified exact-size sample of lineitem by l_returnflag."""
    df = table(spark, sf, "lineitem").select(*LKEY, "l_returnflag")
    return sm.stratified_subsample(df, "l_returnflag", LKEY, SAMPLE_ROWS)


@register(
    "random_subsample",
    f"""
select o_orderkey, o_totalprice from (
  select o_orderkey, o_totalprice, row_number() over (order by {hash_key_sql(['o_orderkey'])}, o_orderkey) as rn from orders)
where rn <= {SAMPLE_ROWS}""",
)
def random_subsample_query(spark: SparkSession, sf: str) -> DataFrame:
    """Exact-size simple random sample (smallest hashes), seed 42."""
    return sm.random_subsample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], SAMPLE_ROWS)


@register(
    "fold_sizes",
    f"""
with c as (select o_orderstatus, count(*) as n from orders group by o_orderstatus),
co as (select o_orderstatus,
              coalesce(sum(n) over (order by o_orderstatus nulls first rows between unbounded preceding and 1 preceding), 0) as off
       from c),
r as (select o_orderkey, o_orderstatus,
             row_number() over (partition by o_orderstatus order by {hash_key_sql(['o_orderkey'])}, o_orderkey) as rn
      from orders),
f as (select r.o_orderstatus, cast((co.off + r.rn - 1) % 3 as integer) as fold
      from r join co on r.o_orderstatus is not distinct from co.o_orderstatus)
select fold, o_orderstatus, count(*) as rows from f group by fold, o_orderstatus""",
)
def fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """W2 invariant report: rows per (fold, class) -- balanced to +-1."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sp.stratified_kfold(df, "o_orderstatus", ["o_orderkey"], 3).groupBy("fold", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows")
    )
