"""Validation splits as a ``fold`` column.

Folds are a pure function of the data and the seed (md5 of the key), so they
are stable under re-planning, retries and partition count, and a DuckDB query
over the same table reproduces them row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_rank, null_safe_join, ordinal

FOLD_COL = "fold"


def n_folds(n_splits: int | None) -> int:
    """k = max(2, n_splits), default 3."""
    return max(2, int(3 if n_splits is None else n_splits))


def row_ordinal(df: DataFrame, order_cols: Sequence[str | Column], ordinal_col: str = "ordinal") -> DataFrame:
    """Explicit row position; positional operators refuse to run without an order."""
    if not order_cols:
        raise ValueError("row_ordinal needs order_by columns: Spark tables have no row order")
    return ordinal(df, order_cols, ordinal_col=ordinal_col)


def stratified_kfold(
    df: DataFrame, target: str, key_cols: Sequence[str], n_splits: int = 3, seed: int = 42
) -> DataFrame:
    """fold = (class offset + rank in class by hash - 1) mod k.

    Every class is dealt round-robin over the folds in hash order, starting where
    the previous class stopped, so each class is balanced to +-1 per fold and the
    fold sizes are balanced to +-1 overall.
    """
    k = n_folds(n_splits)
    class_counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_cn"))
    before = Window.orderBy(F.col(target).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # one row per class (classification targets have few classes).
    class_offsets = class_counts.select(target, F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_coff"))
    ranked = hash_rank(df, key_cols, seed=seed, within=[target], rank_col="_rk")
    out = null_safe_join(ranked, class_offsets, [target])
    return out.withColumn(FOLD_COL, F.pmod(F.col("_coff") + F.col("_rk") - 1, F.lit(k)).cast("int")).drop("_coff", "_rk")


def kfold(df: DataFrame, key_cols: Sequence[str], n_splits: int = 3, seed: int = 42) -> DataFrame:
    """fold = (rank by hash - 1) mod k; sizes balanced to +-1."""
    k = n_folds(n_splits)
    ranked = hash_rank(df, key_cols, seed=seed, rank_col="_rk")
    return ranked.withColumn(FOLD_COL, F.pmod(F.col("_rk") - 1, F.lit(k)).cast("int")).drop("_rk")


def time_split(
    df: DataFrame, order_cols: Sequence[str | Column], n_splits: int = 3, *, keep_ordinal: bool = True
) -> DataFrame:
    """Expanding-window split over an explicit time order.

    With n rows and m = n div (k+1), fold i validates on ordinals
    [n - (k-i)*m, n - (k-i-1)*m) and trains on every ordinal before that start.
    The first n - k*m rows belong to no validation fold (fold is NULL).
    """
    k = n_folds(n_splits)
    n = df.count()
    m = n // (k + 1)
    if m == 0:
        raise ValueError(f"time_split needs at least {k + 1} rows, got {n}")
    start = n - k * m
    out = row_ordinal(df, order_cols)
    fold = F.when(F.col("ordinal") >= F.lit(start), F.floor((F.col("ordinal") - F.lit(start)) / F.lit(m)).cast("int"))
    out = out.withColumn(FOLD_COL, fold)
    return out if keep_ordinal else out.drop("ordinal")


def time_split_train_mask(fold: int, n: int, n_splits: int = 3) -> Column:
    """P11 for W4: training rows of fold ``fold`` are the ordinals before its start."""
    k = n_folds(n_splits)
    m = n // (k + 1)
    return F.col("ordinal") < F.lit(n - (k - fold) * m)


def group_kfold(df: DataFrame, group_col: str, n_splits: int = 3, seed: int = 42) -> DataFrame:
    """K-fold over distinct groups, so no group is on both sides of a split."""
    k = n_folds(n_splits)
    groups = df.select(group_col).distinct()
    ranked = hash_rank(groups, [group_col], seed=seed, rank_col="_rk")
    folds = ranked.select(group_col, F.pmod(F.col("_rk") - 1, F.lit(k)).cast("int").alias(FOLD_COL))
    # one row per group on the right: AQE broadcasts it when small and splits a
    # hot group's partition on the left (skew join) otherwise.
    return null_safe_join(df, folds, [group_col])


def fold_masks(fold: int) -> tuple[Column, Column]:
    """(train rows, validation rows) of a fold-tagged frame."""
    return (F.col(FOLD_COL) != F.lit(fold)) | F.col(FOLD_COL).isNull(), F.col(FOLD_COL) == F.lit(fold)
