"""Model-response transcripts (G1, G2): tool calls and final text from response JSON.

A response is a JSON object ``{"id", "output_text", "output": [item, ...]}``;
items are ``function_call`` (``call_id``, ``name``, ``arguments`` as a JSON
string or object) or ``message`` (``content``: chunks with ``type``/``text``).
Parsing is ``from_json`` + higher-order functions on each row; nothing groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import q

ITEM_SCHEMA = "struct<type:string, call_id:string, name:string, arguments:string, content:array<struct<type:string, text:string>>>"
RESPONSE_SCHEMA = f"struct<id:string, output_text:string, output:array<{ITEM_SCHEMA}>>"


def parse_response(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, RESPONSE_SCHEMA)


def extract_tool_calls(df: DataFrame, response_col: str, keep: list[str]) -> DataFrame:
    """G1: one row per function_call item: (keep..., call_id, name, arguments map).

    ``arguments`` given as a JSON string is parsed; an empty value means ``{}``.
    (A JSON object given inline arrives as its JSON text and parses the same way.)
    """
    items = df.select(*[q(k) for k in keep], F.posexplode(parse_response(q(response_col)).getField("output")).alias("item_pos", "item"))
    calls = items.where(F.col("item.type") == F.lit("function_call"))
    raw = F.coalesce(F.nullif(F.btrim(F.col("item.arguments")), F.lit("")), F.lit("{}"))
    return calls.select(
        *[q(k) for k in keep],
        "item_pos",
        F.col("item.call_id").alias("call_id"),
        F.col("item.name").alias("name"),
        F.from_json(raw, "map<string,string>").alias("arguments"),
    )


def extract_text(response_col: str | Column) -> Column:
    """output_text when non-empty, else the non-empty output_text chunks of
    message items joined by newlines, stripped."""
    r = parse_response(response_col)
    msgs = F.filter(r.getField("output"), lambda it: it.getField("type") == F.lit("message"))
    chunks = F.flatten(
        F.transform(
            msgs,
            lambda it: F.transform(
                F.filter(F.coalesce(it.getField("content"), F.array()), lambda ch: ch.getField("type") == F.lit("output_text")),
                lambda ch: F.coalesce(ch.getField("text"), F.lit("")),
            ),
        )
    )
    joined = F.array_join(F.filter(chunks, lambda s: s != F.lit("")), "\n")
    direct = r.getField("output_text")
    return F.when(F.coalesce(direct, F.lit("")) != F.lit(""), direct).otherwise(F.btrim(joined, F.lit(" \t\r\n")))


def responses_from_turns(df: DataFrame) -> DataFrame:
    """Build one response JSON per conversation turn (test input for G1/G2).

    user turns -> one function_call per line (``read_file`` with ``{"path": line}``);
    assistant turns -> one message per line with an output_text chunk and an empty refusal;
    system turns -> ``output_text`` carries the whole text.
    """
    lines = F.split(F.col("text"), "\n")
    call = lambda line, i: F.struct(
        F.lit("function_call").alias("type"),
        F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit("_"), i.cast("string")).alias("call_id"),
        F.lit("read_file").alias("name"),
        F.to_json(F.struct(line.alias("path"))).alias("arguments"),
        F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"),
    )
    msg = lambda line, i: F.struct(
        F.lit("message").alias("type"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("arguments"),
        F.array(
            F.struct(F.lit("output_text").alias("type"), line.alias("text")),
            F.struct(F.lit("refusal").alias("type"), F.lit("").alias("text")),
        ).alias("content"),
    )
    items = (
        F.when(F.col("role") == "user", F.transform(lines, call))
        .when(F.col("role") == "assistant", F.transform(lines, msg))
        .otherwise(F.array().cast(f"array<{ITEM_SCHEMA}>"))
    )
    resp = F.struct(
        F.concat(F.lit("resp_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("role") == "system", F.col("text")).otherwise(F.lit("")).alias("output_text"),
        items.alias("output"),
    )
    return df.select("conv_id", "turn", "role", F.to_json(resp).alias("response"))
