"""Exact-size deterministic samples.

A sample is "the rows with the smallest md5(key || ':seed')", taken per class
with a proportional quota (stratified) or over the whole table (simple).  Both
are exact in size, reproducible in SQL, and fully distributed (two-phase ranks).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .quality import q
from .ranking import hash_key, hash_rank

# Size rules of the reference.
LARGE_TABULAR_ROWS = 200_000
LARGE_TABULAR_CELLS = 5_000_000
EVAL_SUBSAMPLE_ROWS = 120_000


@dataclass(frozen=True)
class SizeRule:
    large_rows: int = LARGE_TABULAR_ROWS
    large_cells: int = LARGE_TABULAR_CELLS
    sample_rows: int = EVAL_SUBSAMPLE_ROWS


def is_large(rows: int, cols: int, rule: SizeRule = SizeRule()) -> bool:
    """Rows >= 200,000 or rows x columns >= 5,000,000."""
    return rows >= rule.large_rows or rows * max(cols, 1) >= rule.large_cells


def size_report(df: DataFrame, rule: SizeRule = SizeRule()) -> DataFrame:
    """A20 as a one-row table: rows, columns, cells, is_large."""
    cols = len(df.columns)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("rows"),
        F.lit(cols).cast("long").alias("columns"),
        (n * F.lit(cols)).cast("long").alias("cells"),
        ((n >= F.lit(rule.large_rows)) | (n * F.lit(max(cols, 1)) >= F.lit(rule.large_cells))).alias("is_large"),
    )


def class_quota(df: DataFrame, target: str, n_max: int = EVAL_SUBSAMPLE_ROWS) -> DataFrame:
    """Per class (NULL is a class) n_c and quota = max(1, round_half_even(n_c / n * N)), capped at n_c."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("class_rows"))
    # a window over the per-class aggregate (one row per class), not over the rows.
    total = F.sum("class_rows").over(Window.partitionBy())
    quota = F.greatest(F.lit(1), F.bround(F.col("class_rows") / total * F.lit(n_max), 0).cast("long"))
    return counts.select(target, "class_rows", F.least(quota, F.col("class_rows")).alias("quota"))


# The rows a hash threshold lets through beyond the wanted number: six deviations, so a second try is next to never.
MARGIN = 6.0
_SPACE = 16**8


def _near(share: Column, rows: Column) -> Column:
    """The bound on the first 32 bits of the hash below which at least ``share`` of ``rows`` rows are expected to lie."""
    return F.least(F.lit(1.0), share + F.lit(MARGIN) * F.sqrt(share / rows) + F.lit(MARGIN**2) / rows) * F.lit(float(_SPACE))


def _head(key_cols: Sequence[str], seed: int) -> Column:
    return F.conv(F.substring(hash_key(key_cols, seed), 1, 8), 16, 10).cast("double")


def _class_key(target: str) -> Column:
    """A class as text that keeps NULL apart."""
    return F.coalesce(F.concat(F.lit("="), q(target).cast("string")), F.lit("null"))


def stratified_subsample(
    df: DataFrame,
    target: str,
    key_cols: Sequence[str],
    n_max: int = EVAL_SUBSAMPLE_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Per class the quota rows with the smallest hash, then the N smallest overall.

    The class counts give each class a hash threshold; rows above it are filtered out before any shuffle, and only the
    survivors (the sample and a small margin) are written and ranked: the table is read twice, once for its classes only.
    """
    bounds = _written(
        class_quota(df, target, n_max).select(
            _class_key(target).alias("_cls"), _near(F.col("quota") / F.col("class_rows"), F.col("class_rows")).alias("_bound"), "quota"
        ),
        "classes",
    )
    marked = df.withColumn("_cls", _class_key(target)).withColumn("_head", _head(key_cols, seed)).join(bounds, "_cls")
    near = _survivors(marked.where(F.col("_head") < F.col("_bound")))  # one row per class: AQE broadcasts it when small
    found = near.groupBy("_cls").agg(F.count(F.lit(1)).alias("n"))
    both = bounds.join(found, "_cls", "left").agg(F.sum("quota").alias("wanted"), F.max(F.coalesce("n", F.lit(0)) < F.col("quota")).alias("short"))
    wanted, short = both.first()
    if short:
        near = _survivors(marked)
    ranked = hash_rank(near.drop("_bound", "_head"), key_cols, seed=seed, within=["_cls"], rank_col="_crk")
    kept = ranked.where(F.col("_crk") <= F.col("quota")).drop("_crk", "quota", "_cls")
    if (wanted or 0) <= n_max:
        return kept
    return hash_rank(kept, key_cols, seed=seed, rank_col="_grk").where(F.col("_grk") <= F.lit(n_max)).drop("_grk")


def _written(df: DataFrame, name: str) -> DataFrame:
    """A small intermediate table in the shared folder, so that later steps neither compute it again nor lose it with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _survivors(near: DataFrame) -> DataFrame:
    """The rows below the threshold, dealt by hash before they are written: few files however many partitions were read."""
    return _written(near.repartition("_cls", (F.col("_head") / F.lit(float(1 << 16))).cast("int")), "sample")


def random_subsample(df: DataFrame, key_cols: Sequence[str], n_max: int = EVAL_SUBSAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """Exactly min(n, N) rows, the N smallest hashes (``df.sample`` is not exact); only rows near the threshold are ranked."""
    n = df.count()
    if n <= n_max:
        return df
    head = df.withColumn("_cls", F.lit("")).withColumn("_head", _head(key_cols, seed))
    near = _survivors(head.where(F.col("_head") < _near(F.lit(n_max / n), F.lit(float(n))))).drop("_cls", "_head")
    if near.count() < n_max:
        near = df
    return hash_rank(near, key_cols, seed=seed, rank_col="_grk").where(F.col("_grk") <= F.lit(n_max)).drop("_grk")


def subsample_for_eval(
    df: DataFrame,
    target: str,
    key_cols: Sequence[str],
    classification: bool,
    rule: SizeRule = SizeRule(),
    seed: int = 42,
) -> tuple[DataFrame, bool, int]:
    """Subsample only when the table is large and has more than N rows.

    Returns (frame, used_subsample, rows_before).
    """
    n = df.count()
    if not is_large(n, len(df.columns), rule) or n <= rule.sample_rows:
        return df, False, n
    if classification and target in df.columns:
        return stratified_subsample(df, target, key_cols, rule.sample_rows, seed), True, n
    return random_subsample(df, key_cols, rule.sample_rows, seed), True, n
