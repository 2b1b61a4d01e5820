"""Single-pass quality gate for a prediction table.

Every check is computed by **one** aggregation over the submission (the only
shuffle is the one the exact distinct-id count needs; Spark pre-aggregates ids
map-side, so a hot id collapses before the shuffle).  The one-row result is
unpivoted to ``(check_order, check, column, passed, detail)``.
``assert_quality`` raises the first failure in check order, as the reference's
gate does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import boolean_like, integer_like, is_floating
from .schema import id_column_for_check, prediction_columns

REPORT_SCHEMA = "check_order int, check string, column string, passed boolean, detail string"
# Fixed value: below this many rows the constant-prediction check does not apply.
CONSTANT_CHECK_MIN_ROWS = 20


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def type_family(dtype: T.DataType) -> str:
    """Q4: family of a template column: boolean / integer / float / other."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return "other"


def _missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    m = q(c).isNull()
    return m | F.isnan(q(c)) if is_floating(dt) else m


def qa_report(
    submission: DataFrame,
    template: DataFrame,
    test: DataFrame | None = None,
    *,
    expected_rows: int | None = None,
    constant_min_rows: int = CONSTANT_CHECK_MIN_ROWS,
) -> DataFrame:
    """Q3 as a table.  ``expected_rows`` defaults to rows of test, else of template."""
    tmpl_cols = template.columns
    test_cols = test.columns if test is not None else None
    preds = prediction_columns(tmpl_cols, test_cols)
    id_col = id_column_for_check(tmpl_cols, test_cols)
    sub_cols = submission.columns
    if expected_rows is None:
        expected_rows = (test if test is not None else template).count()

    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    null_idx = {}
    for i, c in enumerate(sub_cols):
        null_idx[c] = f"nulls_{i}"
        aggs.append(F.sum(_missing(submission, c).cast("long")).alias(null_idx[c]))
    fam_info: dict[str, tuple[str, str | None]] = {}
    for j, p in enumerate(preds):
        if p not in sub_cols:
            continue
        fam = type_family(template.schema[p].dataType)
        sdt = submission.schema[p].dataType
        numeric = isinstance(sdt, (T.NumericType, T.BooleanType))  # pandas counts bool as numeric
        bad = None
        if fam == "boolean":
            bad = f"bad_{j}"
            aggs.append(F.sum((~_missing(submission, p) & ~boolean_like(q(p))).cast("long")).alias(bad))
        elif fam == "integer" and numeric:
            bad = f"bad_{j}"
            aggs.append(F.sum((~integer_like(q(p))).cast("long")).alias(bad))
        fam_info[p] = (fam, bad)
        # constant check: min == max over non-missing values
        v = F.when(~_missing(submission, p), q(p))
        aggs.append(F.min(v).alias(f"min_{j}"))
        aggs.append(F.max(v).alias(f"max_{j}"))
    # Everything but the ids is one map-side combined aggregation; only the ids themselves are shuffled for their count.
    stats = submission.agg(*aggs)
    if id_col in sub_cols:
        ids = submission.select(q(id_col).alias("id")).where("id is not null").distinct().agg(F.count(F.lit(1)).alias("id_distinct"))
        stats = stats.withColumn("one", F.lit(1)).join(ids.withColumn("one", F.lit(1)), "one")  # two one-row tables

    n = F.col("n")
    rows: list[Column] = []

    def row(order: int, check: str, column: str | None, passed: Column, detail: Column) -> None:
        rows.append(
            F.struct(
                F.lit(order).alias("check_order"),
                F.lit(check).alias("check"),
                F.lit(column).cast("string").alias("column"),
                passed.alias("passed"),
                detail.alias("detail"),
            )
        )

    def txt(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    row(0, "row_count", None, n == F.lit(expected_rows), txt("rows=", n, " expected=", F.lit(expected_rows)))
    row(1, "not_empty", None, n > 0, txt("rows=", n))
    for c in sub_cols:
        k = F.col(null_idx[c])
        row(2, "no_nulls", c, k == 0, txt("nulls=", k))
    if id_col in sub_cols:
        has_null = (F.col(null_idx[id_col]) > 0).cast("long")
        surplus = n - F.col("id_distinct") - has_null
        row(3, "unique_id", id_col, surplus == 0, txt("duplicates=", surplus))
    constant_flags = []
    for j, p in enumerate(preds):
        present = p in sub_cols
        row(4, "prediction_present", p, F.lit(present), F.lit("present" if present else "missing"))
        if not present:
            continue
        fam, bad = fam_info[p]
        nulls = F.col(null_idx[p])
        sdt = submission.schema[p].dataType
        if fam == "boolean":
            row(5, "type_family", p, F.col(bad) == 0, txt("family=boolean bad=", F.col(bad)))
        elif fam in ("integer", "float") and not isinstance(sdt, (T.NumericType, T.BooleanType)):
            row(5, "type_family", p, F.lit(False), F.lit(f"family={fam} not numeric"))
        elif fam == "integer":
            row(5, "type_family", p, F.col(bad) == 0, txt("family=integer bad=", F.col(bad)))
        elif fam == "float":
            row(5, "type_family", p, nulls == 0, txt("family=float bad=", nulls))
        else:
            row(5, "type_family", p, F.lit(True), F.lit("family=other"))
        mn, mx = F.col(f"min_{j}"), F.col(f"max_{j}")
        constant_flags.append((nulls == n) | ((nulls == 0) & (mn == mx)))
    if preds:
        n_const = sum([f.cast("int") for f in constant_flags], F.lit(0)) if constant_flags else F.lit(0)
        applies = (n >= F.lit(constant_min_rows)) & F.lit(len(constant_flags) == len(preds))
        all_const = n_const == F.lit(len(preds))
        row(6, "not_constant", None, ~(applies & all_const), txt("constant_columns=", n_const, f" min_rows={constant_min_rows}"))
    return stats.select(F.inline(F.array(*rows)))


def assert_quality(report: DataFrame) -> None:
    """Raise on the first failed check (the report has one row per check/column)."""
    failed = report.where(~F.col("passed")).orderBy("check_order").limit(1).collect()
    if failed:
        r = failed[0]
        where = f" in column {r['column']!r}" if r["column"] is not None else ""
        raise ValueError(f"submission failed check {r['check']}{where}: {r['detail']}")


def null_report(df: DataFrame) -> DataFrame:
    """(column, nulls, has_nulls) of every column in one aggregation; NaN counts as missing."""
    aggs = [F.coalesce(F.sum(_missing(df, c).cast("long")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), (F.col(f"n{i}") > 0).alias("has_nulls")) for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """A10: (id, copies) of the ids that occur more than once: map-side counts, one shuffle of ids."""
    return df.groupBy(q(id_col)).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def constant_report(df: DataFrame) -> DataFrame:
    """(column, is_constant) by the least and greatest value, NULL being a value too; one aggregation, no distinct."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(df.columns):
        aggs += [F.min(q(c)).alias(f"lo{i}"), F.max(q(c)).alias(f"hi{i}"), F.count(q(c)).alias(f"k{i}")]
        some, all_there = F.col(f"k{i}") > 0, F.col(f"k{i}") == F.col("n")
        rows.append(F.struct(F.lit(c).alias("column"), (~some | (all_there & (F.col(f"lo{i}") == F.col(f"hi{i}")))).alias("is_constant")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def family_report(submission: DataFrame, template: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q4 with F7-F9: (column, family, bad_rows) against the template's type families, in one aggregation."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        family = type_family(template.schema[c].dataType)
        rule = {
            "boolean": lambda: ~_missing(submission, c) & ~boolean_like(q(c)),
            "integer": lambda: ~integer_like(q(c)),
            "float": lambda: _missing(submission, c),
        }
        aggs.append(F.sum(rule.get(family, lambda: F.lit(False))().cast("long")).alias(f"b{i}"))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(family).alias("family"), F.col(f"b{i}").alias("bad_rows")))
    return submission.agg(*aggs).select(F.inline(F.array(*rows)))
