"""CSV scan and sink (S1, S7) with pandas-like missing-value handling.

Reading: header row, inferred types.  The extra NA spellings pandas recognises are
turned into NULL in one projection over the string columns, a column whose other
values are all numbers is a double column, and NaN in floating columns becomes NULL (Spark, unlike pandas,
tells them apart; H5).  Inference needs a pass over the file: pass ``schema=``
for large inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import q
from .csv_records import has_open_lines, physical_lines, read_records

# Strings read as missing (pandas' default NA tokens).
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


# A number as the NA rule sees it: decimal notation with an optional exponent, blanks around it allowed.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool | None = None,
) -> DataFrame:
    """S1.  ``multi_line``: quoted fields hold line ends; by default one pass over the quote characters finds out.

    Such files are read split by split (``csv_records``), the others by Spark's own reader.
    """
    lines = physical_lines(spark, path) if multi_line is not False else None
    if multi_line or lines is not None and has_open_lines(lines):
        df = normalize_missing(read_records(spark, lines, schema, list(na_tokens)), na_tokens)
        return df if schema is not None else numbers_among_missing(df)
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("nanValue", "NaN")
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = normalize_missing(reader.csv(path), na_tokens)
    return df if schema is not None else numbers_among_missing(df)


def numbers_among_missing(df: DataFrame) -> DataFrame:
    """Columns that inference left as text only for their NA spellings become double: all other values are numbers.

    One aggregation over the text columns decides.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    asks = [F.count(q(c)).alias(f"n{i}") for i, c in enumerate(texts)]
    asks += [F.count_if(~q(c).rlike(NUMBER)).alias(f"other{i}") for i, c in enumerate(texts)]
    seen = df.agg(*asks).first()
    numeric = [c for i, c in enumerate(texts) if seen[f"n{i}"] and not seen[f"other{i}"]]
    return df.withColumns({c: F.trim(q(c)).cast("double") for c in numeric}) if numeric else df


def normalize_missing(df: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """NA spellings in string columns and NaN in float columns become NULL (one projection)."""
    out = {}
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(c.isin(list(na_tokens)), F.lit(None).cast("string")).otherwise(c)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out[f.name] = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, path: str, *, single_file: bool = False, order_by: Sequence[str] | None = None) -> str:
    """Header, no index, overwrite.  ``single_file`` funnels the output through
    one task, so it is only for tables known to be small (a submission)."""
    out = df
    if order_by:
        out = out.orderBy(*[q(c) for c in order_by])
    if single_file:
        out = out.coalesce(1)
    # blanks around a value are part of it (Spark's writer would trim them)
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.mode("overwrite").option("header", True).option("escape", '"').options(**keep).csv(path)
    return path
