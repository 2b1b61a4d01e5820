"""Bundles of tables and file discovery (S2, S3, S4, Q7) through Spark's file metadata scan.

Discovery and catalogs use the ``binaryFile`` source with only its metadata
columns selected (``path``, ``length``, ``modificationTime``), so no file
content is read.  A "table" in a bundle may be a single file or a directory of
part files (what Spark writes); both are entries of their parent directory.
"""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv import read_csv

DATA_SUBDIR = "home/data"
SAMPLE_PATTERN = "sample_submission*.csv"
TEST_PATTERN = "test*.csv"


@dataclass
class Bundle:
    train: DataFrame
    test: DataFrame | None = None
    template: DataFrame | None = None


def load_bundle(
    spark: SparkSession,
    train_path: str,
    test_path: str | None = None,
    template_path: str | None = None,
    *,
    fmt: str = "csv",
) -> Bundle:
    """Train is required; test and template are optional."""

    def read(p: str | None) -> DataFrame | None:
        if not p:
            return None
        return read_csv(spark, p) if fmt == "csv" else spark.read.format(fmt).load(p)

    return Bundle(read(train_path), read(test_path), read(template_path))


def _norm(root: str) -> str:
    return root.rstrip("/")


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root`` (recursive): (path, rel, length, modified); metadata only."""
    base = _norm(root)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(base)
        .select("path", "length", "modificationTime")
    )
    # paths come back as file:/... or scheme://...; keep the part after the root
    rel = F.regexp_extract(F.col("path"), "^.*?" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/(.*)$", 1)
    return files.select("path", rel.alias("rel"), "length", F.col("modificationTime").alias("modified")).where(F.col("rel") != "")


def children(spark: SparkSession, root: str, sub: str = "") -> DataFrame:
    """Immediate entries of ``root/sub``: (name, is_dir, files, bytes); hidden/underscore entries skipped."""
    lst = file_listing(spark, root)
    prefix = (sub.strip("/") + "/") if sub.strip("/") else ""
    inside = lst.where(F.col("rel").startswith(prefix)) if prefix else lst
    rest = F.substring(F.col("rel"), len(prefix) + 1, 1 << 20)
    name = F.split(rest, "/").getItem(0)
    is_dir = F.size(F.split(rest, "/")) > 1
    entries = inside.select(name.alias("name"), is_dir.alias("is_dir"), "length")
    entries = entries.where(~F.col("name").startswith("_") & ~F.col("name").startswith("."))
    return entries.groupBy("name").agg(
        F.max("is_dir").alias("is_dir"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def data_dir(spark: SparkSession, root: str) -> str:
    """S3: ``root/home/data`` when it exists, else ``root``."""
    top = children(spark, root, "home")
    has = top.where((F.col("name") == "data") & F.col("is_dir")).limit(1).count() > 0
    return f"{_norm(root)}/{DATA_SUBDIR}" if has else _norm(root)


def find_first(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """The first entry of ``directory`` (sorted by name) matching a glob; 0 or 1 row."""
    regex = fnmatch.translate(pattern)
    entries = children(spark, directory)
    hit = entries.where(F.col("name").rlike(regex))
    return hit.agg(F.min("name").alias("name")).where(F.col("name").isNotNull())


def file_catalog(spark: SparkSession, root: str, sub: str = "") -> DataFrame:
    """Directories first, then files, case-insensitive by name; ``/`` after directory names."""
    entries = children(spark, root, sub)
    shown = F.concat(F.lit(sub.strip("/") + "/" if sub.strip("/") else ""), F.col("name"), F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))
    return entries.select(
        shown.alias("entry"), "is_dir", "files", "bytes", F.lower(F.col("name")).alias("_k")
    ).orderBy(F.col("is_dir").desc(), "_k").drop("_k")


def resolve_inside(root: str, path: str) -> str:
    """S4 guard: a relative path must stay inside the root."""
    parts = []
    for p in path.replace("\\", "/").split("/"):
        if p in ("", "."):
            continue
        if p == "..":
            if not parts:
                raise ValueError(f"Path escapes root: {path}")
            parts.pop()
        else:
            parts.append(p)
    if path.startswith("/"):
        raise ValueError(f"Path escapes root: {path}")
    return "/".join([_norm(root)] + parts)


def written_summary(spark: SparkSession, path: str, preview_chars: int = 400) -> DataFrame:
    """Q7: (exists, files, size_bytes, preview) of a written table folder or file.

    Sizes come from file metadata; the preview is the first ``preview_chars``
    characters of the first part file (by name), read on its own.
    """
    lst = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    lst = lst.where(~F.regexp_extract("path", "([^/]+)$", 1).rlike("^[._]"))
    meta = lst.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("size_bytes"), F.min("path").alias("first"))
    m = meta.first()
    if not m["files"]:
        return spark.createDataFrame([(False, 0, 0, None)], "exists boolean, files long, size_bytes long, preview string")
    # A preview needs no more lines than characters: the scan stops there, whatever the file's size.
    lines = spark.read.text(m["first"]).select(F.substring("value", 1, preview_chars).alias("line")).limit(preview_chars).collect()
    preview = "".join(r["line"] + "\n" for r in lines)[:preview_chars]
    return spark.createDataFrame(
        [(True, m["files"], m["size_bytes"], preview)], "exists boolean, files long, size_bytes long, preview string"
    )
