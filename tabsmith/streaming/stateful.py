"""Per-context rules with state of their own (``transformWithState``): T1 with expiry, T2 as a stream of verdicts.

T2 (``TerminalGuard``)  Per task the state is its first terminal position and the events accepted so far.  The first
    terminal position only ever gets smaller, so a verdict only ever turns from accepted to rejected: a new event is judged
    when it arrives, and an earlier terminal event that arrives late takes the events after it out of the state and judges
    them again.  The output is a changelog; an event is rejected when any of its rows says so, whatever the order, the
    batching and the number of deliveries were.  An accepted event behind the watermark is final, since no terminal event
    before it can still come: an event-time timer takes it out of the state.  The terminal position, one row a task, stays.
T1 (``FirstSuccess``)  Per context the state is the first successful event.  An event-time timer clears it ``retention``
    after that event's time, once the watermark has passed; the changelog keeps the answer.

Both take a ``lateness``: an event that lags further behind the latest one is dropped by the watermark, unjudged.

A task that holds a third of all events is dealt over ``salts`` state keys by the event's hash; terminal events go to all
of them (that copy is the cost of a salt), and only one copy is a row of the output.  State lives in RocksDB, not on the heap.

Defined results: an event without a task belongs to the task NULL and is guarded by terminal events without a task; an
event without a time or an id is not judged and gives no row; an event without a type is not terminal (T2) and not a
success (T1); repeated events are one row of the answer; an empty stream gives no rows; other columns are not carried.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .context import SUCCESS_EXCLUDES, TERMINAL_EVENT_TYPES, run_to_parquet

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SALTS = 8
LATENESS = "1 day"
POSITION = "ts_us long, event_id long"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which ``transformWithState`` needs; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _state_key(column: str) -> Column:
    """The key as text that is never null, whatever its type."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


class TerminalGuard(StatefulProcessor):
    """Rows (ts_us, event_id, terminal, own) of one task and salt to (event_ids, rejected) rows of a changelog.

    Plain rows, not data frames: most keys have a few events a batch, and a frame costs more than they do.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", POSITION)
        self.open = handle.getListState("open", POSITION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.first.get()
        known = least = tuple(known) if known is not None else None
        new = {}  # a set in the order of arrival
        for r in rows:  # the first terminal position of the whole batch before any verdict
            at = (r.ts_us, r.event_id)
            if r.terminal and (least is None or at < least):
                least = at
            if r.own:
                new[at] = None
        accepted, late = self._judged(new, least)
        changed = least != known
        if changed:
            self.first.update(least)
            held = dict.fromkeys(tuple(r) for r in self.open.get())
            kept, again = self._judged(held, least)
            accepted, late = list(dict.fromkeys([*kept, *accepted])), late + again
            if accepted:  # an older timer of the key finds less to take out, which is harmless
                self.handle.registerTimer(self._expiry(accepted))
                self.open.put(accepted)
            elif held:
                self.open.clear()
        elif accepted:
            if not self.open.exists():
                self.handle.registerTimer(self._expiry(accepted))
            self.open.appendList(accepted)
        fresh = [e for t, e in accepted if (t, e) in new]
        for ids, rejected in ((fresh, False), ([e for _, e in late], True)):
            if ids:
                yield Row(event_ids=ids, rejected=rejected)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        left = list(dict.fromkeys(at for at in map(tuple, self.open.get()) if at[0] // 1000 >= watermark))
        if left:
            self.open.put(left)
            self.handle.registerTimer(self._expiry(left))
        else:
            self.open.clear()
        return iter(())

    @staticmethod
    def _expiry(events: list[tuple[int, int]]) -> int:
        return max(t for t, _ in events) // 1000 + 1

    @staticmethod
    def _judged(events: Iterable[tuple[int, int]], least: tuple[int, int] | None) -> tuple[list, list]:
        """(events up to a position, events strictly after it) by time, then id."""
        if least is None:
            return list(events), []
        return [at for at in events if at <= least], [at for at in events if at > least]

    def close(self) -> None:
        pass


def stream_verdicts(stream: DataFrame, task: str = "user_id", salts: int = SALTS, lateness: str = LATENESS) -> DataFrame:
    """T2 as a changelog stream of (event_id, rejected)."""
    events = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    events = events.where("ts is not null and event_id is not null").select(
        _state_key(task).alias("task"),
        "ts",
        F.unix_micros("ts").alias("ts_us"),
        F.col("event_id").cast("long").alias("event_id"),
        F.coalesce(F.col("event_type").isin(TERMINAL_EVENT_TYPES), F.lit(False)).alias("terminal"),
        F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int").alias("home"),
    )
    every = F.when(F.col("terminal"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array("home"))
    dealt = events.withColumn("salt", F.explode(every)).withColumn("own", F.col("salt") == F.col("home")).drop("home")
    verdicts = dealt.groupBy("task", "salt").transformWithState(
        statefulProcessor=TerminalGuard(), outputStructType="event_ids array<long>, rejected boolean", outputMode="update", timeMode="EventTime"
    )
    return verdicts.select(F.explode("event_ids").alias("event_id"), "rejected")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The answer of the changelog: one row per event, rejected when any of its verdicts is; a map-side combined aggregate, no join."""
    log = spark.read.schema("event_id long, rejected boolean").parquet(path)
    return log.groupBy("event_id").agg(F.max("rejected").alias("rejected"))


def run_terminal_guard(stream: DataFrame, out_path: str, checkpoint: str, task: str = "user_id", **kw) -> DataFrame:
    """T2 over all input there is: (event_id, rejected) per event."""
    spark = stream.sparkSession
    with rocksdb_state(spark):
        run_to_parquet(stream_verdicts(stream, task, **kw), out_path, checkpoint, mode="update")
    return read_verdicts(spark, out_path)


class FirstSuccess(StatefulProcessor):
    """Successful events of one context to its changelog of first events (ts_us, event_id), forgotten ``retention`` after them."""

    def __init__(self, retention: dt.timedelta):
        self.retention_ms = int(retention.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", POSITION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.first.get()
        known = tuple(known) if known is not None else None
        least = min((r.ts_us, r.event_id) for r in rows)
        if known is None or least < known:
            if known is not None:
                self.handle.deleteTimer(self._expiry(known))
            self.first.update(least)
            self.handle.registerTimer(self._expiry(least))
            yield Row(context=key[0], ts_us=least[0], event_id=least[1])

    def _expiry(self, position: tuple[int, int]) -> int:
        return position[0] // 1000 + self.retention_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_first_expiring(stream: DataFrame, context: str = "user_id", lateness: str = LATENESS, retention: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """T1 as a changelog stream of (context, ts_us, event_id).

    ``retention`` is how long after its first event a context is remembered; a success after that writes another, later
    row, which ``read_first`` passes over.
    """
    ok = stream.where(~F.col("event_type").isin(SUCCESS_EXCLUDES)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rows = ok.where("ts is not null and event_id is not null").select(_state_key(context).alias("context"), "ts", F.unix_micros("ts").alias("ts_us"), "event_id")
    return rows.groupBy("context").transformWithState(
        statefulProcessor=FirstSuccess(retention), outputStructType="context string, ts_us long, event_id long", outputMode="update", timeMode="EventTime"
    )


def read_first(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(context, event_id): the least row of each context's changelog, the context in its type ``kind``."""
    log = spark.read.schema("context string, ts_us long, event_id long").parquet(path)
    first = F.min(F.struct("ts_us", "event_id")).alias("first")
    value = F.when(F.col("context") != "", F.expr("substring(context, 2)").cast(kind)).alias("context")
    return log.groupBy("context").agg(first).select(value, F.col("first.event_id").alias("event_id"))


def run_first_success(stream: DataFrame, out_path: str, checkpoint: str, context: str = "user_id", **kw) -> DataFrame:
    """T1 over all input there is: (context, event_id) per context."""
    spark = stream.sparkSession
    with rocksdb_state(spark):
        run_to_parquet(stream_first_expiring(stream, context, **kw), out_path, checkpoint, mode="update")
    return read_first(spark, out_path, stream.schema[context].dataType.simpleString())
