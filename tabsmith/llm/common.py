"""Shared helpers of the training-data operators: table access, lineage cuts, text iteration."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_ROWS, scratch_path, small_batches  # noqa: F401

# The six ASCII white-space characters \x20 \x09-\x0D that separate words.
ASCII_SPACE = " \t\n\x0b\x0c\r"
CHUNK_CHARS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result no longer depends on shuffle files of lost executors, and an
    expensive pass over the texts is not repeated by later branches.
    """
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run inside, at most ``rows`` rows at a time go to Python workers: for tables whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``limit`` characters (a longer text stands alone), in order."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > limit:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def crc_fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(mod))

