"""Per-context processing rules as batch jobs and Structured Streaming jobs (T1, T2, streaming QA).

T1  a context (user) is processed once: its first successful message is the
    one processed; later messages are ignored, failed ones before it may retry.
T2  a message that arrives after its task reached a terminal state is rejected.

Batch twins use aggregations (map-side partial ``min`` per key) and a join with
one row per key, never a window per key, so a hot key does not pin one task.
The streaming versions keep the same minimum per key in the state store and as a changelog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import qa_report

# Fixed value: event types that end a task (the "terminal states").
TERMINAL_EVENT_TYPES = ["error"]
SUCCESS_EXCLUDES = ["error"]


def first_success(events: DataFrame, context: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    """T1 batch twin: (context, first successful event) via a partial min per context."""
    ok = events.where(~F.col("event_type").isin(SUCCESS_EXCLUDES))
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("first")
    return ok.groupBy(context).agg(first).select(context, *[F.col(f"first.{c}").alias(c) for c in order])


def terminal_guard(events: DataFrame, task: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    """T2 batch twin: each event with ``rejected`` = a terminal event of its task came strictly before it."""
    term = events.where(F.col("event_type").isin(TERMINAL_EVENT_TYPES))
    first_term = term.groupBy(task).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_ft"))
    # one row per task: AQE broadcasts it when small, otherwise a shuffle join with skew splitting
    j = events.join(first_term, task, "left")
    pos = F.struct(*[F.col(c) for c in order])
    return j.select(*events.columns, (F.col("_ft").isNotNull() & (pos > F.col("_ft"))).alias("rejected"))


# ---------------------------------------------------------------- streaming
def stream_first_success(stream: DataFrame, context: str = "user_id", watermark: str | None = None) -> DataFrame:
    """T1 as a streaming aggregation (update mode): the state is one row per context.

    ``watermark`` bounds the state for event-time input (``ts`` must be a
    TIMESTAMP, not TIMESTAMP_NTZ); without it the rule is "once ever", as in
    the reference.
    """
    s = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        s = s.withWatermark("ts", watermark)
    return first_success(s, context)


def stream_first_terminal(stream: DataFrame, task: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    """The first terminal event of each task as a streaming aggregation (update mode): the state is one row per task.

    A later batch may bring an earlier terminal event; its row then replaces the old one in the changelog.
    """
    term = stream.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("event_type").isin(TERMINAL_EVENT_TYPES))
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("first")
    return term.groupBy(task).agg(first).select(task, *[F.col(f"first.{c}").alias(c) for c in order])


def stream_terminal_guard(stream: DataFrame, out_path: str, checkpoint: str, task: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    """T2 over all input there is: the events log with ``rejected``, right for any batching, order and redelivery.

    Two streaming queries run: one keeps the first terminal event per task and appends its changes to a changelog, the other
    appends the events to a log.  The answer joins both: the least entry of a task's changelog against its events.  So an
    event already stored is judged anew when an earlier terminal event arrives late.  Redelivered events are one row.
    """
    cols = ["event_id", "user_id", "ts", "event_type"]
    events = stream.select(*cols).withColumn("ts", F.col("ts").cast("timestamp"))
    log = run_to_parquet(events, f"{out_path}/events", f"{checkpoint}/events")
    changes = run_to_parquet(stream_first_terminal(events, task, order), f"{out_path}/terminal", f"{checkpoint}/terminal", mode="update")
    return read_terminal_guard(stream.sparkSession, log, changes, task, order)


def read_terminal_guard(spark: SparkSession, log: str, changes: str, task: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    events = spark.read.parquet(log).dropDuplicates(["event_id"])
    schema = events.select(task, *order).schema
    first = spark.read.schema(schema).parquet(changes).groupBy(task).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_ft"))
    pos = F.struct(*[F.col(c) for c in order])
    both = events.join(first, task, "left")  # one row per task: a hot task's events are split by AQE
    return both.select(*events.columns, (F.col("_ft").isNotNull() & (pos > F.col("_ft"))).alias("rejected"))


def run_to_parquet(query_df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> str:
    """Drive a streaming query over all available input (``availableNow``) into Parquet.

    Append-mode output goes through the file sink (exactly-once via its commit
    log).  Update-mode output (an aggregation's changed rows) is appended per
    micro-batch as a changelog in a folder of its own; readers keep the minimum row per key.
    Nothing is held on the driver.
    """
    w = query_df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", path).outputMode("append").start()
    else:  # a batch that is run again writes over its own folder
        q = w.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    q.awaitTermination()
    return path


def run_available(spark: SparkSession, query_df: DataFrame, name: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Drive a streaming query over all available input into a memory table (tests and small outputs only:
    the memory sink keeps every row on the driver)."""
    q = (
        query_df.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.table(name)


def streaming_qa(
    spark: SparkSession,
    stream: DataFrame,
    template: DataFrame,
    test: DataFrame | None,
    out_path: str,
    checkpoint: str,
) -> DataFrame:
    """Streaming QA of an arriving prediction table: the report (Q3) of all rows that have arrived.

    Every micro-batch is stored under its own id (written over if the batch is run again), so the stored rows
    are the table so far; whole-table rules (row count, unique ids, constant predictions) hold over all of
    it, whatever the batches were.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return qa_report(spark.read.schema(stream.schema).parquet(f"{out_path}/batch=*"), template, test)
