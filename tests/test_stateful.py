"""The stateful streams: verdicts under reordering and redelivery, state that expires, defined results of odd events."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tabsmith.plans import q_streams as qs
from tabsmith.session import scratch_path
from tabsmith.streaming import context as cx
from tabsmith.streaming import stateful as st

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, rejected string"
DAY = dt.datetime(2024, 1, 1)


def event(event_id, user, hours, kind="view"):
    return (event_id, user, None if hours is None else DAY + dt.timedelta(hours=hours), kind, "clash")


def stream_of(spark, batches, name):
    path = scratch_path(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run_counting_state(spark, query_df, name):
    """The rows the stream wrote and the state rows after each batch."""
    out = scratch_path(spark, name)
    with st.rocksdb_state(spark):
        q = (
            query_df.writeStream.outputMode("update")
            .option("checkpointLocation", scratch_path(spark, name + "-ckpt"))
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start()
        )
        q.awaitTermination()
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


@pytest.mark.parametrize("salts", [1, 3])
def test_verdicts_under_reordering_and_redelivery(spark, salts):
    first = [event(1, 7, 5), event(2, 7, 9), event(3, 7, 12, "error"), event(4, 7, 13), event(5, 8, 1), event(5, 8, 1)]
    second = [event(6, 7, 8, "error"), event(2, 7, 9), event(7, 7, 8), event(0, 7, 8), event(8, None, 3, "error"), event(9, None, 4)]
    third = [event(10, 8, 2, None), event(11, 8, None), (None, 8, DAY, "error", "x"), event(12, 7, 7), event(1, 7, 5)]
    stream = stream_of(spark, [first, second, third], "verdicts")
    out = st.run_terminal_guard(stream, scratch_path(spark, "v-out"), scratch_path(spark, "v-ckpt"), salts=salts)
    rejected = {2, 3, 4, 7, 9}  # after event 6 of task 7, or event 8 of the task without a name
    assert {r.event_id: r.rejected for r in out.collect()} == {e: e in rejected for e in [*range(11), 12]}
    assert spark.conf.get(st.PROVIDER, None) != st.ROCKSDB


def test_accepted_events_behind_the_watermark_leave_the_state(spark):
    days = [[event(100 * d + k, k, 24 * d + 1) for k in range(20)] for d in range(6)]
    stream = stream_of(spark, days, "expire")
    out, state = run_counting_state(spark, st.stream_verdicts(stream, salts=2, lateness="1 hour"), "expire-out")
    got = st.read_verdicts(spark, out).collect()
    assert len(got) == 120 and not any(r.rejected for r in got)
    kept_for_ever = stream_of(spark, days, "keep")
    _, whole = run_counting_state(spark, st.stream_verdicts(kept_for_ever, salts=2, lateness="100 days"), "keep-out")
    assert max(whole) == whole[-1] and state[-1] < whole[-1]


def test_first_success_state_falls_and_equals_the_batch_rule(spark):
    days = [[event(100 * d + k, 20 * d + k, 24 * d + k / 10, "error" if k % 3 == 0 else "view") for k in range(20)] for d in range(6)]
    days[5].append(event(999, 1, 24 * 5))  # a context that was forgotten comes again: its first event stands
    stream = stream_of(spark, days, "t1")
    out, state = run_counting_state(spark, st.stream_first_expiring(stream, lateness="3 hours", retention=dt.timedelta(hours=6)), "t1-out")
    batch = spark.createDataFrame([e for d in days for e in d], SCHEMA)
    want = sorted((r.user_id, r.event_id) for r in cx.first_success(batch).collect())
    assert sorted((r.context, r.event_id) for r in st.read_first(spark, out).collect()) == want
    assert max(state) > state[-1]


def test_empty_streams_give_no_rows(spark):
    stream = stream_of(spark, [[]], "none")
    assert st.run_terminal_guard(stream, scratch_path(spark, "n-out"), scratch_path(spark, "n-ckpt")).count() == 0
    assert st.run_first_success(stream, scratch_path(spark, "f-out"), scratch_path(spark, "f-ckpt")).count() == 0


class _State:
    """A value or a list of one key that counts the calls made to it."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def get(self):
        self.calls.append("get")
        return iter(self.held or []) if isinstance(self.held, list) or self.held is None and self.listed else self.held

    def exists(self):
        self.calls.append("exists")
        return bool(self.held)

    def update(self, value):
        self.calls.append("update")
        self.held = value

    put = update

    def appendList(self, values):
        self.calls.append("append")
        self.held = [*(self.held or []), *values]

    def clear(self):
        self.calls.append("clear")
        self.held = None


class _Handle:
    def __init__(self):
        self.calls = []

    def _new(self, listed):
        state = _State(self.calls)
        state.listed = listed
        return state

    def getValueState(self, name, schema):
        return self._new(False)

    def getListState(self, name, schema):
        return self._new(True)

    def registerTimer(self, at):
        self.calls.append("timer")


def test_a_key_takes_plain_rows_and_few_state_calls():
    handle, guard = _Handle(), st.TerminalGuard()
    guard.init(handle)

    def batch(*rows):
        del handle.calls[:]
        out = list(guard.handleInputRows(("=7", 0), iter([Row(ts_us=t, event_id=e, terminal=x, own=o) for t, e, x, o in rows]), None))
        return {e: r.rejected for r in out for e in r.event_ids}, len(out)

    assert batch((5, 1, False, True), (9, 2, False, True), (9, 2, False, True)) == ({1: False, 2: False}, 1)
    assert handle.calls == ["get", "exists", "timer", "append"]
    assert batch((7, 4, True, False), (8, 3, False, True), (6, 5, False, True)) == ({5: False, 2: True, 3: True}, 2)
    assert len(handle.calls) == 5 and sorted(guard.open.held) == [(5, 1), (6, 5)]
    assert batch((10, 6, False, True)) == ({6: True}, 1)
    assert handle.calls == ["get"]
    assert batch((1, 7, True, False)) == ({1: True, 5: True}, 1)
    assert guard.open.held is None


def test_a_share_is_several_files_with_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame([event(k, k % 7, k if k % 10 else None) for k in range(400)], SCHEMA)
    one, parts = qs._shuffled_files(spark, df, "event_id", "share-one", files=3)
    assert parts == 1 and len(spark.read.parquet(one).inputFiles()) == 3
    monkeypatch.setattr(qs, "ROWS_PER_FILE", 40)
    many, parts = qs._shuffled_files(spark, df, "event_id", "share-many", files=3)
    assert parts == 4 and len(spark.read.parquet(many).inputFiles()) == 12
    rows = [sorted(map(str, spark.read.schema(df.schema).parquet(p).collect())) for p in (one, many)]
    assert rows[0] == rows[1] and len(rows[0]) > 400 and len(set(rows[0])) == 400
