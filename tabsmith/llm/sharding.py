"""Sharding by longest-processing-time scheduling of groups that must stay together.

Rows of one text are a group; its size is the sum of its rows' sizes.  Groups, largest first, go to
the least-loaded shard, which a heap gives.  What the heap sees is bounded: a group over
1 / BUNDLES of all bytes is an item of its own (there are BUNDLES of them at most), and all other groups
are gathered by a hash of the text into BUNDLES bundles, which are items too.  So at most 2 * BUNDLES
items are sorted and assigned on the driver, and as many go back by broadcast; rows find their shard without a
shuffle.  A shard's load exceeds the mean by at most one item, and the last items are small.

The slot of a row in its shard comes from counts: a shard is cut by a hash into cells of about
CELL_ROWS rows, a window over the cells' counts gives each its first slot, and rows are numbered
inside their cell, so that a shard with most of the rows is numbered by many tasks.

Defined results: a null text has no bytes and is in one group with the empty texts; repeated rows are
counted and numbered each; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 40
ROW_BYTES = 16
BUNDLES = 20_000
CELL_ROWS = 5_000


def schedule(items: list[tuple[str, int, int]], shards: int) -> list[tuple[str, int, int]]:
    """(item, shard, rows of the shard) of items (item, size, rows): the largest first to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    rows, placed = [0] * shards, []
    for item, size, n in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        rows[shard] += n
        placed.append((item, shard))
    return [(item, shard, rows[shard]) for item, shard in placed]


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def assign_shards(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of (doc_id, text)."""
    text = F.col("text")
    group = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.select("doc_id", row_size(text).alias("size"), crc.alias("text_crc32"), group.alias("group"))
    rows = cut(spark, rows.withColumn("bundle", F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(bundles)))), "sizes")
    groups = cut(spark, rows.groupBy("group", "bundle").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") * bundles > total  # fewer than ``bundles`` groups can be
    items = groups.groupBy(F.when(large, F.col("group")).otherwise(F.col("bundle")).alias("item")).agg(F.sum("size"), F.sum("n"))
    plan = schedule([tuple(r) for r in items.collect()], shards)
    plan = spark.createDataFrame(plan, "item string, shard int, shard_rows long")
    whole = plan.select(F.col("item").alias("group"), F.struct("shard", "shard_rows").alias("own"))
    shared = plan.select(F.col("item").alias("bundle"), F.struct("shard", "shard_rows").alias("rest"))
    placed = rows.join(F.broadcast(whole), "group", "left").join(F.broadcast(shared), "bundle", "left")
    at = F.coalesce("own", "rest")
    cells = F.ceil(at["shard_rows"] / CELL_ROWS)
    cell = F.pmod(F.xxhash64("doc_id", "group"), cells)
    placed = placed.select("doc_id", "size", "text_crc32", "group", at["shard"].alias("shard"), cell.alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "group"))
    numbered = placed.withColumn("place", inside)
    return numbered.join(firsts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot")
    )


def shard_report(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shard and slot of every row, under the law of near-equal bytes."""
    found = assign_shards(spark, docs, shards)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS, per_file: int = 1_000_000) -> None:
    """Write (doc_id, text) as Parquet folders ``shard=k``, each sorted by slot in files of at most ``per_file`` rows."""
    found = assign_shards(spark, docs, shards).select("doc_id", "text_crc32", "size", "shard", "slot")
    keyed = docs.select("doc_id", "text").withColumns(
        {"text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "size": row_size(F.col("text"))}
    )
    # Repeated rows of one id and text are alike: numbering them on both sides pairs each with one slot.
    same = Window.partitionBy("doc_id", "text_crc32", "size")
    left = keyed.withColumn("copy", F.row_number().over(same.orderBy("text")))
    right = found.withColumn("copy", F.row_number().over(same.orderBy("shard", "slot")))
    keys = ["text_crc32", "size", "copy"]
    both = left.alias("l").join(right.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))])
    out = both.select("l.doc_id", "l.text", "r.shard", "r.slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.option("maxRecordsPerFile", per_file).partitionBy("shard").parquet(path)
