"""Records of CSV files whose quoted fields hold line ends, read by many tasks a file.

A split of a file does not know whether it begins inside a quoted field.  So the quote characters of every
split are counted first (one aggregation, one row a split); the running parity over a file's splits tells which of
them begin inside quotes, and with that each split finds its own first true record boundary.  What a split holds before
it belongs to the record that an earlier split left open; these fragments, two a split at most, are put together by a
small aggregation.  All other records never leave their task.

Quoting is that of RFC 4180 and of the sink: a field with a quote, a separator or a line end is quoted, and a quote in it is
doubled.  A lone quote inside an unquoted field would turn the parity; such files are not CSV in this sense.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FULL, HEAD, TAIL = 0, 1, 2
RECORD_SCHEMA = "file string, block long, first boolean, kind int, value string"
# The types that a text column may turn out to be, narrowest first (those of Spark's own inference).
INFERRED = ("int", "bigint", "double", "boolean", "date", "timestamp")


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value, odd): the lines of the files between line feeds; odd: the line turns from inside quotes to outside or back."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", (quotes % 2 == 1).alias("odd")
    )


def has_open_lines(lines: DataFrame) -> bool:
    """Whether any line ends inside a quoted field."""
    return not lines.where("odd").isEmpty()


def splits_inside_quotes(lines: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside a quoted field: at most a row a split of the input."""
    per = lines.groupBy("file", "block").agg(F.sum(F.col("odd").cast("int")).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.sum("n").over(before)).where("before % 2 = 1").select("file", "block", F.lit(True).alias("inside"))


def _cut_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of each split, whose lines come in order; the part before the first boundary is a head, an open end a tail."""
    split, held, inside, head, first = None, [], False, False, True
    out: list[tuple] = []

    def close(kind: int) -> None:
        nonlocal held, head, first
        if held:
            out.append((*split, first and split[1] == 0, kind, "\n".join(held)))
        held, head, first = [], False, False

    for batch in batches:
        for file, block, value, odd, begins in zip(batch["file"], batch["block"], batch["value"], batch["odd"], batch["inside"]):
            if (file, block) != split:
                if split:
                    close(HEAD if head else TAIL)
                split, inside, head, first = (file, block), bool(begins), bool(begins), True
            held.append(value)
            inside ^= bool(odd)
            if not inside:
                close(HEAD if head else FULL)
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "first", "kind", "value"])
            out = []
    if split:
        close(HEAD if head else TAIL)
    if out:
        yield pd.DataFrame(out, columns=["file", "block", "first", "kind", "value"])


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, first, value): the records as texts; first: the record stands first in its file."""
    inside = F.broadcast(splits_inside_quotes(lines))  # only splits whose border falls into a field: a few bytes for 128 MB of input each
    marked = lines.join(inside, ["file", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    pieces = marked.select("file", "block", "value", "odd", "inside").mapInPandas(_cut_records, RECORD_SCHEMA)
    whole = pieces.where(F.col("kind") == FULL).select("file", "first", "value")
    parts = pieces.where(F.col("kind") != FULL)
    order = [F.col("block"), F.col("kind")]  # a split's head comes before its tail
    opened = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.withColumn("record", opened).groupBy("file", "record")
    joined = joined.agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "kind", "value"))).alias("parts"))
    joined = joined.select("file", "first", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    return whole.union(joined).withColumn("value", F.regexp_replace("value", "\r$", ""))


def inferred_types(df: DataFrame, missing: list[str]) -> dict[str, str]:
    """The narrowest type that all values of each text column have, by one aggregation; values in ``missing`` decide nothing."""
    names = [f.name for f in df.schema.fields]
    asks = []
    for i, c in enumerate(names):
        value = F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`"))
        asks.append(F.count(value).alias(f"n{i}"))
        # a date is ten characters: Spark's cast takes many more texts for one
        checked = {"date": F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), "timestamp": F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d"), value)}
        checked["boolean"] = F.when(F.lower(value).isin("true", "false"), value)
        asks += [F.count(checked.get(t, value).try_cast(t)).alias(f"{t}{i}") for t in INFERRED]
    seen = df.agg(*asks).first()
    return {c: next((t for t in INFERRED if seen[f"n{i}"] and seen[f"{t}{i}"] == seen[f"n{i}"]), "string") for i, c in enumerate(names)}


def read_records(spark: SparkSession, lines: DataFrame, schema: T.StructType | str | None, missing: list[str]) -> DataFrame:
    """The records of CSV files with a header as columns; without a schema the types are inferred."""
    records = csv_records(lines)
    top = records.where("first").orderBy("file").limit(1).collect()
    if not top:
        return spark.createDataFrame([], schema if schema is not None else T.StructType([]))
    names = next(csv.reader(io.StringIO(top[0]["value"], newline="")))
    rows = records.where("not first and value <> ''").select("value")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "nanValue": "NaN"}
    if schema is not None:
        given = spark.createDataFrame([], schema).schema
        return rows.select(F.from_csv("value", _ddl(given), options).alias("r")).select("r.*")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    parsed = rows.select(F.from_csv("value", _ddl(texts), options).alias("r")).select("r.*")
    kinds = inferred_types(parsed, missing)
    return parsed.select(*[(F.col(f"`{c}`") if kinds[c] == "string" else F.col(f"`{c}`").try_cast(kinds[c])).alias(c) for c in names])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
