"""Table profiling.

``table_profile`` is one aggregation over all columns.  Text/datetime detection
looks at the first 100 non-null values of each non-numeric column in a stated
key order (parity with the reference's head-of-file sample); each sample is a
bounded top-k (``TakeOrderedAndProject``), never a global sort.  ``sample="all"``
uses every value instead, in a single aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clamp_int, is_floating, lenient_timestamp
from .quality import q

# Fixed values of the reference's detection rules.
TEXT_MIN_AVG_LEN = 20.0
DATETIME_MIN_SHARE = 0.8
HEAD_SAMPLE = 100
PREVIEW_MAX_ROWS = 20


def is_numeric_type(dt: T.DataType) -> bool:
    """numeric feature: numbers and booleans."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def table_profile(df: DataFrame, *, approx_distinct: bool = False) -> DataFrame:
    """A1: per column (position, column, dtype, rows, nulls, min/max) from one aggregation."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    rows = []
    for i, f in enumerate(df.schema.fields):
        c, dt = q(f.name), f.dataType
        miss = c.isNull() | F.isnan(c) if is_floating(dt) else c.isNull()
        aggs.append(F.sum(miss.cast("long")).alias(f"z{i}"))
        if isinstance(dt, T.NumericType):
            v = F.when(~miss, c.cast("double"))
            aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
            num = (F.col(f"a{i}"), F.col(f"b{i}"))
            txt = (F.lit(None).cast("string"), F.lit(None).cast("string"))
        elif isinstance(dt, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            aggs += [F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}")]
            num = (F.lit(None).cast("double"), F.lit(None).cast("double"))
            txt = (F.col(f"a{i}"), F.col(f"b{i}"))
        else:
            num = (F.lit(None).cast("double"), F.lit(None).cast("double"))
            txt = (F.lit(None).cast("string"), F.lit(None).cast("string"))
        extra = []
        if approx_distinct:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
            extra = [F.col(f"d{i}").alias("approx_distinct")]
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(dt.simpleString()).alias("dtype"),
                F.col("rows").alias("rows"),
                F.col(f"z{i}").alias("nulls"),
                num[0].alias("min_num"),
                num[1].alias("max_num"),
                txt[0].alias("min_text"),
                txt[1].alias("max_text"),
                *extra,
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def preview(df: DataFrame, order_by: Sequence[str], max_rows: int = 5) -> DataFrame:
    """L1: first rows in a stated order, count clamped to 1..20 (a bounded top-k)."""
    return df.orderBy(*[q(c) for c in order_by]).limit(clamp_int(max_rows, 1, PREVIEW_MAX_ROWS))


def value_sample_stats(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], *, sample: str = "all", head: int = HEAD_SAMPLE
) -> DataFrame:
    """A4 + A5: per column (column, sample_rows, avg_len, datetime_share).

    sample="all": every non-null value, all columns in one map-side combined aggregation of one scan;
    sample="head" (L2): the first ``head`` non-null values by ``order_by`` (a bounded top-k per column).
    """
    schema = df.schema
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, sample_rows long, avg_len double, datetime_share double")

    def stats(base: DataFrame, names: Sequence[str]) -> DataFrame:
        aggs, rows = [], []
        for i, c in enumerate(names):
            there = q(c).isNotNull()
            parsed = lenient_timestamp(q(c), schema[c].dataType).isNotNull().cast("double")
            aggs += [
                F.count(q(c)).alias(f"n{i}"),
                F.avg(F.when(there, F.char_length(q(c).cast("string")))).alias(f"l{i}"),
                F.avg(F.when(there, parsed)).alias(f"d{i}"),
            ]
            rows.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"n{i}").alias("sample_rows"),
                    F.coalesce(f"l{i}", F.lit(0.0)).alias("avg_len"),
                    F.coalesce(f"d{i}", F.lit(0.0)).alias("datetime_share"),
                )
            )
        return base.agg(*aggs).select(F.inline(F.array(*rows)))

    if sample == "all":
        return stats(df, columns)
    out = None
    for c in columns:
        part = stats(df.where(q(c).isNotNull()).orderBy(*[q(k) for k in order_by]).limit(head), [c])
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class FeatureSummary:
    numeric_columns: list[str] = field(default_factory=list)
    categorical_columns: list[str] = field(default_factory=list)
    text_columns: list[str] = field(default_factory=list)
    datetime_columns: list[str] = field(default_factory=list)
    column_count: int = 0

    @property
    def text_heavy(self) -> bool:
        return bool(self.text_columns)

    @property
    def datetime_heavy(self) -> bool:
        return bool(self.datetime_columns)


def feature_summary(
    df: DataFrame, exclude: Sequence[str], order_by: Sequence[str], *, sample: str = "all"
) -> FeatureSummary:
    """P5: numeric / categorical split by type; text and datetime flags from A4/A5.

    Text and datetime are not exclusive; native date/timestamp columns are
    datetime by type.  ``column_count`` = columns - |exclude| (reference rule).
    """
    ex = set(exclude)
    out = FeatureSummary(column_count=len(df.columns) - len(ex))
    cats = []
    for f in df.schema.fields:
        if f.name in ex:
            continue
        if is_numeric_type(f.dataType):
            out.numeric_columns.append(f.name)
        else:
            out.categorical_columns.append(f.name)
            cats.append(f.name)
    if cats:
        stats = {r["column"]: r for r in value_sample_stats(df, cats, order_by, sample=sample).collect()}
        for c in cats:
            r = stats[c]
            if r["avg_len"] >= TEXT_MIN_AVG_LEN:
                out.text_columns.append(c)
            if is_temporal_type(df.schema[c].dataType) or (r["sample_rows"] > 0 and r["datetime_share"] >= DATETIME_MIN_SHARE):
                out.datetime_columns.append(c)
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A2: (column, distinct_values), NULL not counted: one map-side combined distinct of (column, value as text) pairs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
