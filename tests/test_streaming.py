"""Streams equal their batch twins; the watermarked T1 keeps bounded state."""

import uuid

from pyspark.sql import functions as F

from tabsmith.session import scratch_path
from tabsmith.sources.tables import table
from tabsmith.streaming import context as cx

SF = "/root/testdata/sf0.001"


def _stream(spark):
    schema = table(spark, SF, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def test_first_success_stream_with_watermark_equals_batch(spark):
    name = f"t1w_{uuid.uuid4().hex[:8]}"
    out = cx.run_available(spark, cx.stream_first_success(_stream(spark), watermark="1 day"), name, scratch_path(spark, "t1w"))
    batch = cx.first_success(table(spark, SF, "events"))
    got = sorted((r["user_id"], r["event_id"]) for r in out.collect())
    want = sorted((r["user_id"], r["event_id"]) for r in batch.collect())
    assert got == want and len(got) > 0


def test_terminal_guard_stream_equals_batch_on_any_batching(spark):
    events = table(spark, SF, "events")
    src = scratch_path(spark, "t2-in")
    reverse = events.orderBy(F.desc("ts")).limit(5000)
    reverse.repartition(5).write.parquet(src)
    reverse.limit(200).coalesce(1).write.mode("append").parquet(src)  # delivered again
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = cx.stream_terminal_guard(stream, scratch_path(spark, "t2"), scratch_path(spark, "t2-ckpt"))
    batch = cx.terminal_guard(reverse)
    got = sorted((r["event_id"], r["rejected"]) for r in out.collect())
    assert got == sorted((r["event_id"], r["rejected"]) for r in batch.collect())
    assert any(r for _, r in got)  # some events arrive after a terminal one


def test_streaming_qa_checks_the_whole_table(spark):
    src = scratch_path(spark, "qa-in")
    ids = spark.range(100).select(F.col("id"), F.rand(1).alias("p"))
    ids.coalesce(1).write.parquet(src)
    ids.coalesce(1).write.mode("append").parquet(src)  # the same ids in a second batch
    template = spark.range(100).select("id", F.lit(0.5).alias("p"))
    stream = spark.readStream.schema(ids.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rep = cx.streaming_qa(spark, stream, template, None, scratch_path(spark, "qa-rows"), scratch_path(spark, "qa-ckpt"))
    passed = {r["check"]: r["passed"] for r in rep.collect()}
    assert passed["unique_id"] is False and passed["row_count"] is False and passed["no_nulls"] is True
