"""Registered queries: per-context rules, batch twins and Structured Streaming runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import fixture, table
from ..streaming import context as cx
from ..streaming import stateful
from .q_quality import _QA_BAD_SQL
from .registry import register

_FIRST_SQL = """
select user_id, ts, event_id from (
  select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as rn
  from events where event_type <> 'error') where rn = 1"""

_GUARD_SQL = """
with ft as (select user_id, ts as fts, event_id as fid from (
              select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as rn
              from events where event_type = 'error') where rn = 1)
select e.event_id, e.user_id, e.event_type,
       coalesce(e.ts > ft.fts or (e.ts = ft.fts and e.event_id > ft.fid), false) as rejected
from events e left join ft on e.user_id = ft.user_id"""


@register("first_per_context", _FIRST_SQL)
def first_per_context(spark: SparkSession, sf: str) -> DataFrame:
    """T1 batch twin: the first successful event of each user."""
    return cx.first_success(table(spark, sf, "events"))


@register("terminal_guard", _GUARD_SQL)
def terminal_guard(spark: SparkSession, sf: str) -> DataFrame:
    """T2 batch twin: events after the user's first terminal ('error') event are rejected."""
    g = cx.terminal_guard(table(spark, sf, "events"))
    return g.select("event_id", "user_id", "event_type", "rejected")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    # a file stream reads a folder; the glob filter keeps only the events table
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf)


@register("first_per_context_stream", _FIRST_SQL.replace("select user_id, ts, event_id from (", "select user_id, event_id from (", 1))
def first_per_context_stream(spark: SparkSession, sf: str) -> DataFrame:
    """T1 as a stream: readStream over events -> per-user state (update mode) -> Parquet changelog.

    The changelog holds each user's updated first-success row per micro-batch;
    the minimum per user is the current answer.
    """
    path = cx.run_to_parquet(cx.stream_first_success(_event_stream(spark, sf)), scratch_path(spark, "t1-out"),
                             scratch_path(spark, "t1-ckpt"), mode="update")
    log = spark.read.schema("user_id long, ts timestamp, event_id long").parquet(path)
    best = log.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("b"))
    return best.select("user_id", F.col("b.event_id").alias("event_id"))


ROWS_PER_FILE = 1_000_000


def _shuffled_files(spark: SparkSession, df: DataFrame, key: str, name: str, files: int = 6) -> tuple[str, int]:
    """(folder, files a share): the table as several shares in an order unlike that of its rows, with one row in 16 delivered in
    two of them.  A share is one file for each ``ROWS_PER_FILE`` of its rows: its sort and its write are not one task's."""
    order = F.md5(F.col(key).cast("string"))
    again = df.where(F.substring(order, 1, 1) == "0")
    path = scratch_path(spark, name)
    last_first = F.desc("ts") if "ts" in df.columns else F.desc(key)
    parts = max(1, -(-df.count() // (files * ROWS_PER_FILE)))
    for k in range(files):
        share = F.pmod(F.crc32(order.cast("binary")), F.lit(files))
        part = df.where(share == k).union(again.where(share == (k + 1) % files))
        part.repartitionByRange(parts, last_first).sortWithinPartitions(last_first).write.mode("append").parquet(path)
    return path, parts


@register("terminal_guard_stream", _GUARD_SQL)
def terminal_guard_stream(spark: SparkSession, sf: str) -> DataFrame:
    """T2 as streams (first-terminal state and event log) over several files out of order with redelivered events."""
    events = table(spark, sf, "events")
    src, parts = _shuffled_files(spark, events, "event_id", "t2-in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", parts).parquet(src)
    out = cx.stream_terminal_guard(stream, scratch_path(spark, "t2-out"), scratch_path(spark, "t2-ckpt"))
    return out.select("event_id", "user_id", "event_type", "rejected")


def _files_in_time_order(spark: SparkSession, df: DataFrame, name: str, files: int = 4) -> str:
    """The table as files of successive spans of time, written one after the other."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    path = scratch_path(spark, name)
    if ends["lo"] is None:
        df.write.parquet(path)
        return path
    span = (ends["hi"] - ends["lo"]) // files + 1
    for k in range(files):
        df.where(F.floor((ts - F.lit(ends["lo"])) / F.lit(span)) == k).write.mode("append").parquet(path)
    return path


@register("terminal_guard_stateful", "select event_id, rejected from (" + _GUARD_SQL + ")")
def terminal_guard_stateful(spark: SparkSession, sf: str) -> DataFrame:
    """T2 as one stream of verdicts with state of its own, over files out of order with redelivered events; nothing is joined again."""
    events = table(spark, sf, "events")
    src, parts = _shuffled_files(spark, events, "event_id", "t2s-in", files=3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", parts).parquet(src)
    # the files are dealt by hash: an event may lag by all the time that the table spans
    return stateful.run_terminal_guard(stream, scratch_path(spark, "t2s-out"), scratch_path(spark, "t2s-ckpt"), salts=4, lateness="100 years")


@register("first_per_context_expiring", _FIRST_SQL.replace("select user_id, ts, event_id from (", "select user_id, event_id from (", 1))
def first_per_context_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """T1 as a stream with a watermark whose state a timer clears, over files that arrive in the order of time."""
    events = table(spark, sf, "events")
    src = _files_in_time_order(spark, events, "t1e-in")
    # a span's files are read in any order: the lateness covers one span
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(src)
    first = stateful.run_first_success(stream, scratch_path(spark, "t1e-out"), scratch_path(spark, "t1e-ckpt"), lateness="40 days")
    return first.select(F.col("context").alias("user_id"), "event_id")


@register("streaming_qa", _QA_BAD_SQL)
def streaming_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Q3 over a broken prediction table that arrives in many small batches: ids repeat across batches, the report is the batch one's."""
    src = scratch_path(spark, "preds")
    bad = fixture(spark, sf, "v_orders_bad")
    bad.repartition(8, F.md5(F.col("o_orderkey").cast("string")), F.rand(3)).write.parquet(src)
    stream = spark.readStream.schema(bad.schema).option("maxFilesPerTrigger", 1).parquet(src)
    return cx.streaming_qa(spark, stream, fixture(spark, sf, "v_orders_template"), fixture(spark, sf, "v_orders_all_test"),
                           scratch_path(spark, "qa-rows"), scratch_path(spark, "qa-ckpt"))
