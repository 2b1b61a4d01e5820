"""Registered queries: profiling and task inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as pf
from ..operators.features import frequency_table
from ..operators.sampling import size_report
from ..sources.tables import fixture, table, with_views
from . import task as tk
from .registry import register

LINEITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
LINEITEM_COLS = [
    ("l_orderkey", "bigint", "num"),
    ("l_partkey", "bigint", "num"),
    ("l_suppkey", "bigint", "num"),
    ("l_linenumber", "int", "num"),
    ("l_quantity", "double", "num"),
    ("l_extendedprice", "double", "num"),
    ("l_discount", "double", "num"),
    ("l_tax", "double", "num"),
    ("l_returnflag", "string", "text"),
    ("l_linestatus", "string", "text"),
    ("l_shipdate", "timestamp_ntz", "text"),
]


def _profile_sql(tbl: str, cols) -> str:
    parts = []
    for i, (c, dtype, kind) in enumerate(cols):
        miss = f"{c} is null or isnan({c})" if dtype == "double" else f"{c} is null"
        if kind == "num":
            mm = f"min(cast({c} as double)), max(cast({c} as double)), cast(null as varchar), cast(null as varchar)"
        else:
            mm = f"cast(null as double), cast(null as double), cast(min({c}) as varchar), cast(max({c}) as varchar)"
        parts.append(
            f"select {i} as position, '{c}' as \"column\", '{dtype}' as dtype, count(*) as rows, "
            f"cast(sum(case when {miss} then 1 else 0 end) as bigint) as nulls, {mm} from {tbl}"
        )
    first = parts[0].replace(
        "cast(null as varchar), cast(null as varchar) from",
        "cast(null as varchar) as min_text, cast(null as varchar) as max_text from",
    ).replace("max(cast(l_orderkey as double))", "max(cast(l_orderkey as double)) as max_num").replace(
        "min(cast(l_orderkey as double))", "min(cast(l_orderkey as double)) as min_num"
    )
    return "\nunion all ".join([first] + parts[1:])


@register("table_profile", _profile_sql("lineitem", LINEITEM_COLS))
def table_profile_query(spark: SparkSession, sf: str) -> DataFrame:
    """A1: one-pass per-column profile of lineitem."""
    return pf.table_profile(table(spark, sf, "lineitem"))


@register(
    "preview",
    "select * from lineitem order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice limit 5",
)
def preview_query(spark: SparkSession, sf: str) -> DataFrame:
    """L1: first 5 rows by key (bounded top-k)."""
    return pf.preview(table(spark, sf, "lineitem"), LINEITEM_KEY, 5)


@register(
    "is_large",
    """
select count(*) as rows, cast(11 as bigint) as columns, count(*) * 11 as cells,
       count(*) >= 200000 or count(*) * 11 >= 5000000 as is_large from lineitem""",
)
def is_large_query(spark: SparkSession, sf: str) -> DataFrame:
    """Size rule of the reference (200,000 rows or 5,000,000 cells)."""
    return size_report(table(spark, sf, "lineitem"))


@register(
    "value_counts",
    with_views(
        "select coalesce(event_type, 'nan') as value, count(*) as rows from v_events group by coalesce(event_type, 'nan')",
        "v_events",
    ),
)
def value_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    """A3: value counts on the string form, NULL counted as 'nan'."""
    counts = frequency_table(fixture(spark, sf, "v_events"), "event_type")
    return counts.select(F.col("_fv").alias("value"), F.col("_fc").cast("long").alias("rows"))


@register(
    "target_cardinality",
    """
select 'o_orderstatus' as "column", count(distinct o_orderstatus) as distinct_values from orders
union all select 'o_orderpriority', count(distinct o_orderpriority) from orders
union all select 'o_custkey', count(distinct o_custkey) from orders""",
)
def target_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """A2: exact distinct non-null values of several columns in one aggregation."""
    return pf.distinct_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def _head_sql(src: str, col: str, key: str, expr: str) -> str:
    return f"(select '{col}' as \"column\", {expr} from (select {col} from {src} where {col} is not null))"


@register(
    "text_columns",
    "\nunion all ".join(
        _head_sql("documents", c, "doc_id", "count(*) as sample_rows, avg(length(" + c + ")) as avg_len, avg(length(" + c + ")) >= 20 as is_text")
        for c in ["text", "lang", "source"]
    ),
)
def text_columns_query(spark: SparkSession, sf: str) -> DataFrame:
    """A4: mean length of all non-null values; text when >= 20."""
    df = table(spark, sf, "documents")
    s = pf.value_sample_stats(df, ["text", "lang", "source"], ["doc_id"])
    return s.select("column", "sample_rows", "avg_len", (F.col("avg_len") >= pf.TEXT_MIN_AVG_LEN).alias("is_text"))


_DT = "avg(case when try_cast({c} as timestamp) is not null then 1.0 else 0.0 end)"


@register(
    "datetime_columns",
    with_views(
        "\nunion all ".join(
            _head_sql("v_events", c, "event_id", f"count(*) as sample_rows, {_DT.format(c=c)} as datetime_share, {_DT.format(c=c)} >= 0.8 as is_datetime")
            for c in ["ts_text", "event_type", "props"]
        ),
        "v_events",
    ),
)
def datetime_columns_query(spark: SparkSession, sf: str) -> DataFrame:
    """A5: share of all non-null values that parse as datetimes; datetime when >= 0.8."""
    df = fixture(spark, sf, "v_events")
    s = pf.value_sample_stats(df, ["ts_text", "event_type", "props"], ["event_id"])
    return s.select("column", "sample_rows", "datetime_share", (F.col("datetime_share") >= pf.DATETIME_MIN_SHARE).alias("is_datetime"))


@register(
    "feature_summary",
    with_views(
        """
with h_ts as (select ts_text from v_events_train where ts_text is not null),
     h_p as (select props from v_events_train where props is not null)
select 'value' as "column", 'numeric' as family, false as is_text, false as is_datetime
union all select 'ts_text', 'categorical', (select avg(length(ts_text)) >= 20 from h_ts),
       (select avg(case when try_cast(ts_text as timestamp) is not null then 1.0 else 0.0 end) >= 0.8 from h_ts)
union all select 'props', 'categorical', (select avg(length(props)) >= 20 from h_p),
       (select avg(case when try_cast(props as timestamp) is not null then 1.0 else 0.0 end) >= 0.8 from h_p)""",
        "v_events_train",
    ).replace(")\n\nwith h_ts", "),\nh_ts", 1),
)
def feature_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    """P5: numeric/categorical by type, text and datetime flags from all values."""
    df = fixture(spark, sf, "v_events_train")
    fs = pf.feature_summary(df, ["event_id", "user_id", "event_type"], ["event_id"])
    rows = [(c, "numeric", False, False) for c in fs.numeric_columns]
    rows += [(c, "categorical", c in fs.text_columns, c in fs.datetime_columns) for c in fs.categorical_columns]
    return spark.createDataFrame(rows, "column string, family string, is_text boolean, is_datetime boolean")


@register(
    "task_type",
    """
select 'orders' as tbl, 'o_orderstatus' as target,
       case when count(distinct o_orderstatus) <= 2 then 'binary_classification' else 'multiclass_classification' end as task_type
from orders
union all select 'labels', 'quality',
       case when count(quality) < count(*) then 'regression'
            when count(distinct quality) <= 2 then 'binary_classification'
            when count(distinct quality) <= 20 then 'multiclass_classification' else 'regression' end
from labels
union all select 'lineitem', 'l_linenumber',
       case when count(l_linenumber) < count(*) then 'regression'
            when count(distinct l_linenumber) <= 2 then 'binary_classification'
            when count(distinct l_linenumber) <= 20 then 'multiclass_classification' else 'regression' end
from lineitem
union all select 'customer', 'c_nationkey',
       case when count(c_nationkey) < count(*) then 'regression'
            when count(distinct c_nationkey) <= 2 then 'binary_classification'
            when count(distinct c_nationkey) <= 20 then 'multiclass_classification' else 'regression' end
from customer
union all select 'orders', 'o_totalprice', 'regression' from (select count(*) from orders)""",
)
def task_type_query(spark: SparkSession, sf: str) -> DataFrame:
    """V2 over several targets: string / integer (<= 2, <= 20 values) / float rules."""
    rows = []
    for tbl, target in [("orders", "o_orderstatus"), ("labels", "quality"), ("lineitem", "l_linenumber"),
                        ("customer", "c_nationkey"), ("orders", "o_totalprice")]:
        df = table(spark, sf, tbl)
        rows.append((tbl, target, tk.infer_task_type(df, target)))
    return spark.createDataFrame(rows, "tbl string, target string, task_type string")


def _report_sql(body: str, *views: str) -> str:
    return with_views(body, *views)


@register(
    "infer_task_orders",
    with_views(
        """
select 'regression' as task_type, 'o_totalprice' as target, 'o_totalprice' as target_candidates,
       'o_orderkey' as id_candidates, 'time_split' as validation, 'neg_rmse' as metric_family,
       (select max(l) >= 20 from (select avg(length(o_orderstatus)) as l from (select o_orderstatus from v_orders_train)
                                   union all select avg(length(o_orderpriority)) from (select o_orderpriority from v_orders_train)
                                   union all select avg(length(cast(o_orderdate as varchar))) from (select o_orderdate from v_orders_train))) as text_heavy,
       true as datetime_heavy, 'o_custkey' as numeric_columns,
       'o_orderstatus,o_orderpriority,o_orderdate' as categorical_columns, '' as text_columns,
       'o_orderdate' as datetime_columns, 4 as column_count
from (select count(*) from v_orders_train)""",
        "v_orders_train",
    ),
)
def infer_task_orders(spark: SparkSession, sf: str) -> DataFrame:
    """V1 on orders: regression on o_totalprice; native timestamp -> time split."""
    train = fixture(spark, sf, "v_orders_train")
    test = fixture(spark, sf, "v_orders_test")
    tmpl = test.select("o_orderkey", F.lit(0.5).alias("o_totalprice"))
    return tk.report_frame(spark, tk.infer_task(train, test, tmpl))


@register(
    "infer_task_docs",
    with_views(
        """
with h as (select text, lang, source from v_docs_train)
select case when (select count(quality) from v_docs_train) < (select count(*) from v_docs_train) then 'regression'
            when (select count(distinct quality) from v_docs_train) <= 2 then 'binary_classification'
            when (select count(distinct quality) from v_docs_train) <= 20 then 'multiclass_classification'
            else 'regression' end as task_type,
       'quality' as target, 'quality' as target_candidates, 'doc_id' as id_candidates,
       'grouped_kfold_recommended' as validation, 'accuracy' as metric_family,
       (select avg(length(text)) >= 20 or avg(length(lang)) >= 20 or avg(length(source)) >= 20 from h) as text_heavy,
       false as datetime_heavy, 'n_chars' as numeric_columns, 'text,lang,source' as categorical_columns,
       concat_ws(',', case when (select avg(length(text)) from h) >= 20 then 'text' end,
                      case when (select avg(length(lang)) from h) >= 20 then 'lang' end,
                      case when (select avg(length(source)) from h) >= 20 then 'source' end) as text_columns,
       '' as datetime_columns, 4 as column_count""",
        "v_docs_train",
    ).replace("\nwith h as", ",\nh as", 1),
)
def infer_task_docs(spark: SparkSession, sf: str) -> DataFrame:
    """V1 on labelled documents: binary quality target, text-heavy, id -> grouped folds."""
    train = fixture(spark, sf, "v_docs_train")
    test = fixture(spark, sf, "v_docs_test")
    tmpl = test.select("doc_id", F.lit(0).alias("quality"))
    return tk.report_frame(spark, tk.infer_task(train, test, tmpl))


@register(
    "infer_task_events",
    with_views(
        """
with h as (select ts_text, props from v_events_train)
select case when (select count(distinct event_type) from v_events_train) <= 2 then 'binary_classification'
            else 'multiclass_classification' end as task_type,
       'event_type' as target, 'props' as target_candidates, 'event_id,user_id' as id_candidates,
       case when (select avg(case when try_cast(ts_text as timestamp) is not null then 1.0 else 0.0 end) >= 0.8 from h
                  where ts_text is not null) then 'time_split' else 'grouped_kfold_recommended' end as validation,
       'accuracy' as metric_family,
       (select avg(length(ts_text)) >= 20 from h where ts_text is not null) as text_heavy,
       (select avg(case when try_cast(ts_text as timestamp) is not null then 1.0 else 0.0 end) >= 0.8 from h
         where ts_text is not null) as datetime_heavy,
       'value' as numeric_columns, 'ts_text,props' as categorical_columns,
       case when (select avg(length(ts_text)) >= 20 from h where ts_text is not null) then 'ts_text' else '' end as text_columns,
       case when (select avg(case when try_cast(ts_text as timestamp) is not null then 1.0 else 0.0 end) >= 0.8 from h
                  where ts_text is not null) then 'ts_text' else '' end as datetime_columns,
       3 as column_count""",
        "v_events_train",
    ).replace("\nwith h as", ",\nh as", 1),
)
def infer_task_events(spark: SparkSession, sf: str) -> DataFrame:
    """V1 on events with target given: multiclass event_type, parseable text timestamps."""
    train = fixture(spark, sf, "v_events_train")
    test = fixture(spark, sf, "v_events_test")
    return tk.report_frame(spark, tk.infer_task(train, test, None, target="event_type", order_by=["event_id"]))


@register(
    "label_index",
    """
select o_orderstatus as label, cast(row_number() over (order by o_orderstatus) - 1 as integer) as label_index, rows
from (select o_orderstatus, count(*) as rows from orders group by o_orderstatus)""",
)
def label_index_query(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted classes and their index."""
    return tk.label_index(table(spark, sf, "orders"), "o_orderstatus")
