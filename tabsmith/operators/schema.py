"""Schema arithmetic.

These decisions read only ``df.columns`` and run no job.  ``schema_diff_frame``
turns the ordered set operations into a small table for reporting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def ordered_except(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Names of ``left`` not in ``right``, in ``left`` order."""
    r = set(right)
    return [c for c in left if c not in r]


def ordered_intersect(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Names of ``left`` also in ``right``, in ``left`` order."""
    r = set(right)
    return [c for c in left if c in r]


def ordered_distinct(names: Sequence[str]) -> list[str]:
    """U4: first occurrence wins (dict keys keep their first position)."""
    return list(dict.fromkeys(names))


def _first_choice(*choices: Sequence[str]) -> list[str]:
    """The first choice that has any name."""
    return next((list(c) for c in choices if c), [])


def _difference(left: Sequence[str] | None, right: Sequence[str] | None) -> list[str]:
    """U2 of two schemas; nothing when one of the tables is not given."""
    return [] if left is None or right is None else ordered_except(left, right)


def target_candidates(train: Sequence[str], test: Sequence[str] | None, sample: Sequence[str] | None) -> list[str]:
    """Sample-only columns, else train-only columns, else the last train column."""
    return _first_choice(_difference(sample, test), _difference(train, test), train[-1:])


def id_candidates(train: Sequence[str], test: Sequence[str] | None, sample: Sequence[str] | None, limit: int | None = None) -> list[str]:
    """Test columns that the sample shares or whose name ends in ``id``, the shared ones first and in the sample's order.

    All of them are returned, so no id column can slip into the features; a report may show the
    first ``limit`` (L7).
    """
    by_name = [c for c in test or [] if str(c)[-2:].lower() == "id"]
    return ordered_distinct([*ordered_intersect(sample or [], test or []), *by_name])[:limit]


def prediction_columns(template: Sequence[str], test: Sequence[str] | None) -> list[str]:
    """Template minus test; else all but the first; else all."""
    return _first_choice(_difference(template, test), template[1:], template)


def id_column_for_check(template: Sequence[str], test: Sequence[str] | None) -> str:
    """Q5: first template column shared with test, else the first template column."""
    if test is not None:
        shared = ordered_intersect(template, test)
        if shared:
            return shared[0]
    return template[0]


def rename_plan(submission: Sequence[str], template: Sequence[str], test: Sequence[str] | None) -> dict[str, str]:
    """Rename the single unknown extra column onto the single missing prediction column."""
    missing_pred = ordered_except(prediction_columns(template, test), submission)
    extra = ordered_except(submission, template)
    extra_pred = [c for c in extra if test is None or c not in set(test)]
    if len(missing_pred) == 1 and len(extra_pred) == 1:
        return {extra_pred[0]: missing_pred[0]}
    return {}


def schema_diff_frame(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """U2/U3 as a table: (position, column, in_right) over the left schema."""
    rset = set(right.columns)
    rows = [(i, c, c in rset) for i, c in enumerate(left.columns)]
    return spark.createDataFrame(rows, "position int, column string, in_right boolean")
