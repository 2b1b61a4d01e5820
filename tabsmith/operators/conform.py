"""Repair a prediction table against its template.

The reference attaches missing columns by row position.  Spark tables have no
row order, so columns are attached by an id key when one is shared (the default,
defect D10), and by an explicit ordinal only when the caller names the order of
both sides (``order_by``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import assert_quality, q, qa_report
from .ranking import ordinal
from .schema import id_candidates, id_column_for_check, ordered_except, prediction_columns, rename_plan

# Table names never picked as a prediction table, and the
# preferred names searched first.
RESERVED_TABLE_NAMES = ["train.csv", "test.csv", "sample_submission.csv", "submission.csv"]
PREFERRED_TABLE_NAMES = [
    "submission",
    "submission_df",
    "predictions_df",
    "pred_df",
    "result_df",
    "output_df",
    "final_submission",
]


@dataclass
class ConformResult:
    frame: DataFrame
    renamed: dict[str, str] = field(default_factory=dict)
    attached: dict[str, str] = field(default_factory=dict)
    changed: bool = False


def _check_key(left: DataFrame, right: DataFrame, key: str) -> None:
    """A join on ``key`` keeps the left rows as they are: the right side has each key once and every left key."""
    if not right.groupBy(q(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"cannot join on {key!r}: it is not unique")
    if not left.select(q(key)).join(right.select(q(key)), key, "left_anti").isEmpty():
        raise ValueError(f"cannot join on {key!r}: some rows have no match")


def attach_by_key(left: DataFrame, source: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """J1 (key form): take ``cols`` from ``source`` by an equi-join on ``key``; raises where rows would multiply or go unmatched."""
    if not cols:
        return left
    right = source.select(q(key), *[q(c) for c in cols])
    _check_key(left, right, key)
    # Both sides are id-keyed tables of similar size: a shuffle join; AQE splits
    # a skewed key partition and broadcasts the right side when it is small.
    return left.join(right, on=key, how="left")


def attach_by_ordinal(
    left: DataFrame,
    source: DataFrame,
    cols: Sequence[str],
    left_order: Sequence[str],
    source_order: Sequence[str],
) -> DataFrame:
    """J1 (positional form): the i-th row of ``left`` gets the i-th row of ``source``.

    Positions are dense ordinals of explicit, unique sort orders on both sides.
    """
    lo = ordinal(left, list(left_order), ordinal_col="_pos")
    so = ordinal(source.select(*[q(c) for c in dict.fromkeys([*source_order, *cols])]), list(source_order), ordinal_col="_pos")
    keep = [q(c) for c in cols]
    return lo.join(so.select("_pos", *keep), "_pos", "left").drop("_pos")


def _shared_key(sub_cols: Sequence[str], src_cols: Sequence[str], template_cols: Sequence[str], test_cols: Sequence[str] | None) -> str | None:
    """An id column that both sides have: the one the quality gate checks, or an id candidate; never a prediction."""
    preds = set(prediction_columns(template_cols, test_cols))
    ids = [c for c in [id_column_for_check(template_cols, test_cols), *id_candidates(template_cols, test_cols, template_cols)] if c not in preds]
    return next((c for c in ids if c in sub_cols and c in src_cols), None)


def conform(
    submission: DataFrame,
    template: DataFrame,
    test: DataFrame | None = None,
    *,
    order_by: Mapping[str, Sequence[str]] | None = None,
) -> ConformResult:
    """Q1/Q2 column repair: P7 rename -> J1 attach -> P6 select template order.

    ``order_by`` (optional) maps "submission"/"test"/"template" to sort columns,
    enabling the positional attach when no id key is shared.
    """
    tmpl_cols = template.columns
    test_cols = test.columns if test is not None else None
    # the submission's order columns only carry row positions: not candidates for renaming
    aux = set(order_by.get("submission", [])) if order_by else set()
    renamed = rename_plan([c for c in submission.columns if c not in aux], tmpl_cols, test_cols)
    sub = submission
    for old, new in renamed.items():
        sub = sub.withColumnRenamed(old, new)
    attached: dict[str, str] = {}
    missing_now = ordered_except(tmpl_cols, sub.columns)
    by_source: dict[str, list[str]] = {}
    for c in missing_now:
        by_source.setdefault("test" if test is not None and c in test_cols else "template", []).append(c)
    # test first (it may bring the id the template join needs); one join per source table
    for src_name in ("test", "template"):
        cols = by_source.get(src_name)
        if not cols:
            continue
        src = test if src_name == "test" else template
        key = _shared_key(sub.columns, src.columns, tmpl_cols, test_cols)
        if key is not None:
            sub = attach_by_key(sub, src, key, cols)
        elif order_by and "submission" in order_by and src_name in order_by:
            sub = attach_by_ordinal(sub, src, cols, order_by["submission"], order_by[src_name])
        else:
            raise ValueError(f"cannot attach columns {cols}: no shared id column and no order_by for a positional attach")
        attached.update({c: src_name for c in cols})
    missing = ordered_except(tmpl_cols, sub.columns)
    if missing:
        raise ValueError(f"submission is still missing columns: {missing}")
    out = sub.select(*[q(c) for c in tmpl_cols])
    changed = bool(renamed or attached or list(submission.columns) != list(tmpl_cols))
    return ConformResult(out, renamed, attached, changed)


def repair(submission: DataFrame, template: DataFrame, test: DataFrame | None = None, **kw) -> DataFrame:
    """Q1: never raises; returns the input unchanged when it cannot be repaired.

    One row rule for both repair and normalize (D11): compare with test when
    present, else with the template.
    """
    try:
        expected = (test if test is not None else template).count()
        if submission.count() != expected:
            return submission
        return conform(submission, template, test, **kw).frame
    except ValueError:
        return submission


def normalize(
    submission: DataFrame,
    template: DataFrame | None,
    test: DataFrame | None = None,
    *,
    check: bool = True,
    **kw,
) -> DataFrame:
    """Q2: row count must match; attach, reorder, then run the quality gate (raises)."""
    if template is None:
        return submission
    expected = (test if test is not None else template).count()
    got = submission.count()
    if got != expected:
        raise ValueError(f"submission row count {got} does not match expected {expected}")
    out = conform(submission, template, test, **kw).frame
    if check:
        assert_quality(qa_report(out, template, test, expected_rows=expected))
    return out


def fill_template(template: DataFrame, predictions: DataFrame, key: str, value_col: str) -> DataFrame:
    """Replace the last template column by ``value_col`` of ``predictions`` joined on ``key``.

    Only for templates of at least two columns (else the template is returned).
    """
    cols = template.columns
    if len(cols) < 2:
        return template
    last = cols[-1]
    preds = predictions.select(q(key), q(value_col).alias("_pred"))
    _check_key(template, preds, key)
    joined = template.join(preds, key, "left")
    return joined.select(*[q(c) if c != last else F.col("_pred").alias(last) for c in cols])


def choose_candidate(
    tables: Mapping[str, DataFrame],
    expected_rows: int | None,
    preferred: Sequence[str] = PREFERRED_TABLE_NAMES,
) -> DataFrame:
    """P10: one row (name, rows, preferred_rank) of the table to use, or no row.

    Preferred names first (in the given order), then the rest by name; reserved
    names are skipped; with ``expected_rows`` only tables of that size qualify.
    """
    parts = []
    pref = {n: i for i, n in enumerate(preferred)}
    for name, df in tables.items():
        if name in RESERVED_TABLE_NAMES:
            continue
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("name"), "rows", F.lit(pref.get(name, len(pref))).alias("preferred_rank")
            )
        )
    if not parts:
        raise ValueError("no candidate tables")
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    if expected_rows is not None:
        counts = counts.where(F.col("rows") == F.lit(expected_rows))
    best = F.min(F.struct("preferred_rank", "name", "rows"))
    # one row per candidate table: a tiny aggregate.
    return counts.agg(best.alias("b")).where(F.col("b").isNotNull()).select("b.name", "b.rows", "b.preferred_rank")


def finalize(
    tables: Mapping[str, DataFrame],
    template: DataFrame | None,
    test: DataFrame | None = None,
    *,
    predictions: DataFrame | None = None,
    fallback: DataFrame | None = None,
    **kw,
) -> tuple[DataFrame | None, DataFrame]:
    """Q6: the first of three sources that gives a table, and its summary (exists, name, rows, columns).

    1. a prediction table of the expected size (P10), repaired (Q1); 2. the template filled from
    ``predictions``, a table (id, value) (J3); 3. ``fallback``, a candidate file, repaired likewise.
    """
    spark = next(df for df in (*tables.values(), template, predictions, fallback) if df is not None).sparkSession
    expected = None if template is None else (test if test is not None else template).count()
    name, frame = None, None
    named = {n: df for n, df in tables.items() if n not in RESERVED_TABLE_NAMES}
    chosen = choose_candidate(named, expected).collect() if named else []
    if chosen:
        name, frame = chosen[0]["name"], tables[chosen[0]["name"]]
    elif predictions is not None and template is not None and len(template.columns) > 1:
        key, value = predictions.columns
        return _summarised(spark, "predictions", fill_template(template, predictions, key, value))
    elif fallback is not None:
        name, frame = "fallback", fallback
    if frame is not None and template is not None:
        frame = repair(frame, template, test, **kw)
    return _summarised(spark, name, frame)


def _summarised(spark: SparkSession, name: str | None, frame: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    if frame is None:
        return None, spark.createDataFrame([(False, None, None, None)], "exists boolean, name string, rows long, columns string")
    summary = frame.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(True).alias("exists"), F.lit(name).alias("name"), "rows", F.lit(",".join(frame.columns)).alias("columns")
    )
    return frame, summary
