"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is a run: its rows' digests, grouped (Spark sorts a run by digest and merges equal
neighbours before the exchange).  In each round ``FAN_IN`` neighbouring runs exchange what they hold and
merge into one, until one run is left, so P runs take log(P) / log(FAN_IN) rounds.  A merged run is spread over
tasks by its digests, never held by one.  At every level an entry keeps the smallest identifier of its
texts and how many they are; on the way back each level hears the verdict of the run above.  A key is
thus met by ``FAN_IN`` entries at most in a round, and by a partition's own rows at the bottom: a text that is
a third of the corpus makes no hot task.

Entries are verified at every level: two are one text only if SHA-256, byte length and a second hash all
agree, so a text that had another's digest alone would stay apart.

Defined results: a null text is empty; among equal texts the smallest doc_id stays (null last), of rows
that repeat it exactly one; a group of null doc_ids has keep_id null; an empty table gives no rows;
other columns, whatever their names, pass through ``drop_exact_copies`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

FAN_IN = 16
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
TEXT_KEY = ["digest", "size", "witness"]


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest_rows(spark: SparkSession, docs: DataFrame, carried: Column) -> DataFrame:
    """(carried, id, run, row, digest, size, witness) of every row, written once: run is the input partition, row a unique number."""
    texts = docs.select(carried.alias("carried"), F.col("doc_id").alias("id"), normalised(F.col("text")).alias("norm"))
    rows = texts.select(
        "carried",
        "id",
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.octet_length("norm").alias("size"),
        F.xxhash64("norm").alias("witness"),
    )
    return cut(spark, rows, "digests")


def merge_rounds(spark: SparkSession, rows: DataFrame, fan_in: int = FAN_IN) -> list[DataFrame]:
    """The runs of each level, from the partitions' own to the last one: (run, key, least, n)."""
    least = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least")
    level = rows.groupBy("run", *TEXT_KEY).agg(least, F.count(F.lit(1)).alias("n"))
    levels = [cut(spark, level, "run")]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        above = F.floor(F.col("run") / fan_in).cast("int").alias("run")
        level = levels[-1].groupBy(above, *TEXT_KEY).agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        levels.append(cut(spark, level, "run"))
        runs = -(-runs // fan_in)
    return levels


def with_verdicts(spark: SparkSession, docs: DataFrame, carried: Column, fan_in: int = FAN_IN) -> DataFrame:
    """The rows with ``least`` (the struct of the row that stays) and ``n``, the size of their group."""
    rows = digest_rows(spark, docs, carried)
    levels = merge_rounds(spark, rows, fan_in)
    verdict = levels.pop()
    while levels:
        below = levels.pop().select("run", *TEXT_KEY, F.floor(F.col("run") / fan_in).cast("int").alias("above"))
        verdict = below.join(verdict.withColumnRenamed("run", "above"), ["above", *TEXT_KEY]).drop("above")
    return rows.join(verdict, ["run", *TEXT_KEY])


def duplicate_report(spark: SparkSession, docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: the document of its text that stays, the size of the group, whether it stays, and the digest."""
    found = with_verdicts(spark, docs, F.lit(None).cast("int"), fan_in)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("least.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("least.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(spark: SparkSession, docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with one row of each text, all its columns as they were."""
    found = with_verdicts(spark, docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), fan_in)
    return found.where(F.col("row") == F.col("least.row")).select("carried.*")


REPORT_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       row_number() over (partition by norm order by doc_id nulls last) = 1 as kept, sha256(norm) as text_sha256
from d window same as (partition by norm)
"""
