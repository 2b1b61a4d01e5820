"""Exact, fully distributed ranks and ordinals.

Spark has no row order, and ``row_number()`` over an unpartitioned window (or a
window partitioned by a hot class) runs in one task.  Both helpers here compute
the *same numbers* as that window, in two phases:

``hash_rank``  rank in md5(key || ':' || seed) order, optionally within groups.
    The first hex digits of the hash (4 -> 65,536 buckets, enough parallel window
    tasks for thousands of cores) define buckets that follow hash order, so a
    rank is  (rows in earlier buckets of the group) + (row_number inside the
    bucket).  The per-bucket counts are a small aggregate (groups x 16^digits
    rows) and buckets are uniform by construction, so a hot group is spread over
    all buckets instead of landing in one task.

``ordinal``    dense 0-based position in an arbitrary unique sort order.
    A global sort is range-partitioned by Spark; each row gets its partition id
    and position, the sorted frame is checkpointed (so the ids are stable under
    re-execution and executor loss), and partition offsets come from a count per
    partition (one row per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

HASH_COL = "_h"
BUCKET_COL = "_hb"


def hash_key(key_cols: Sequence[str], seed: int | str = 42) -> Column:
    """md5 of the key text and the seed; identical in Spark and DuckDB.

    Single key:  md5(cast(k as string) || ':42')
    Composite:   md5(concat_ws('|', cast(k1 as string), ...) || ':42')
    A NULL key hashes as the empty text, so its rows have a place in the order too.
    """
    if len(key_cols) == 1:
        text = F.coalesce(F.col(key_cols[0]).cast("string"), F.lit(""))
    else:
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols])
    return F.md5(F.concat(text, F.lit(f":{seed}")))


def hash_key_sql(key_cols: Sequence[str], seed: int | str = 42) -> str:
    """The same expression as SQL text, for oracles."""
    if len(key_cols) == 1:
        text = f"cast({key_cols[0]} as string)"
    else:
        text = "concat_ws('|', " + ", ".join(f"cast({k} as string)" for k in key_cols) + ")"
    return f"md5({text} || ':{seed}')"


def hash_rank(
    df: DataFrame,
    key_cols: Sequence[str],
    *,
    seed: int | str = 42,
    within: Sequence[str] = (),
    rank_col: str = "rank",
    digits: int = 4,
    keep_hash: bool = False,
) -> DataFrame:
    """Add ``rank_col`` = 1-based row_number() over (partition by within order by hash, key).

    ``key_cols`` must identify rows (ties in the hash are broken by the key).
    """
    within = list(within)
    h = df.withColumn(HASH_COL, hash_key(key_cols, seed)).withColumn(
        BUCKET_COL, F.conv(F.substring(HASH_COL, 1, digits), 16, 10).cast("int")
    )
    counts = h.groupBy(*within, BUCKET_COL).agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy(*within).orderBy(BUCKET_COL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, BUCKET_COL, F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    # offsets has at most (#groups x 16^digits) rows; AQE turns this join into a
    # broadcast when its measured size is small and keeps a shuffle join otherwise.
    inner = Window.partitionBy(*within, BUCKET_COL).orderBy(HASH_COL, *key_cols)
    ranked = null_safe_join(h.withColumn("_rn", F.row_number().over(inner)), offsets, [*within, BUCKET_COL])
    ranked = ranked.withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("long"))
    drop = ["_rn", "_off", BUCKET_COL] + ([] if keep_hash else [HASH_COL])
    return ranked.drop(*drop)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL keys match each other (a NULL class is a class)."""
    renamed = right.select(*[F.col(c).alias(f"_r{i}") if c in on else F.col(c) for i, c in enumerate(right.columns)])
    idx = {c: i for i, c in enumerate(right.columns)}
    cond = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"_r{idx[c]}"))
        cond = term if cond is None else cond & term
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"_r{idx[c]}" for c in on])


def ordinal(df: DataFrame, order_cols: Sequence[str | Column], *, ordinal_col: str = "ordinal") -> DataFrame:
    """Add a dense 0-based ``ordinal_col`` following ``order_cols`` (which must be unique)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sorted_df = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    # Pin partition ids and positions: a reliable checkpoint in the shared folder
    # (persisted first so the sort runs once, not again for the checkpoint write).
    sorted_df.persist(StorageLevel.MEMORY_AND_DISK)
    pinned = sorted_df.checkpoint(eager=True)
    sorted_df.unpersist()
    sorted_df = pinned
    part = F.shiftright(F.col("_mid"), 33)
    pos = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_df.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_pn"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sorted frame: a bounded broadcast.
    offsets = counts.select("_p", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_off"))
    return (
        sorted_df.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(ordinal_col, (F.col("_off") + pos).cast("long"))
        .drop("_p", "_off", "_mid")
    )
