"""Registered queries: text, JSON, base64 and transcript operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as fx
from ..operators import text as tx
from ..operators import transcripts as tr
from ..sources.tables import table
from .registry import register

_WS = "' ' || chr(9) || chr(13) || chr(10)"
_TERMS_SQL = """
with toks as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as t from documents),
terms as (
  select doc_id, unnest(t) as term from toks
  union all
  select doc_id, t[i] || ' ' || t[i + 1] from (select doc_id, t, unnest(generate_series(1, len(t) - 1)) as i from toks where len(t) >= 2)
),
dt as (select doc_id, term, count(*) as tf from terms group by doc_id, term),
st as (select term, sum(tf) as corpus_tf, count(*) as doc_freq from dt group by term),
top as (select * from st order by corpus_tf desc, term limit 5000),
voc as (select term, corpus_tf, doc_freq,
               ln((1.0 + (select count(*) from documents)) / (1.0 + doc_freq)) + 1.0 as idf,
               cast(row_number() over (order by term) - 1 as integer) as term_index from top)"""


@register(
    "tfidf_vocab",
    _TERMS_SQL + "\nselect term, cast(corpus_tf as bigint) as corpus_tf, doc_freq, round(idf, 9) as idf, term_index from voc",
)
def tfidf_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """A17/L8/E7 fit: top-5,000 1-2-gram vocabulary of all documents with smoothed idf."""
    voc = tx.tfidf_vocabulary(table(spark, sf, "documents"), "doc_id", "text")
    return voc.select("term", F.col("corpus_tf").cast("long").alias("corpus_tf"), "doc_freq", F.round("idf", 9).alias("idf"), "term_index")


@register(
    "tfidf_weights",
    _TERMS_SQL
    + """,
w as (select dt.doc_id, dt.term, voc.term_index, dt.tf * voc.idf as w from dt join voc on dt.term = voc.term),
nrm as (select doc_id, sqrt(sum(w * w)) as n from w group by doc_id)
select w.doc_id, w.term, w.term_index, round(w.w / nrm.n, 9) as weight from w join nrm on w.doc_id = nrm.doc_id""",
)
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """E7 transform: L2-normalised tf-idf weights of every document over the vocabulary."""
    docs = table(spark, sf, "documents")
    voc = tx.tfidf_vocabulary(docs, "doc_id", "text")
    w = tx.tfidf_weights(docs, "doc_id", "text", voc)
    return w.select("doc_id", "term", "term_index", F.round("weight", 9).alias("weight"))


_LOG_SPARK = (
    "concat('/srv/app/train.py:', cast(event_id as string), ': UserWarning: ', event_type, '\\n', "
    "'  warnings.warn(msg)\\n', 'step ', cast(event_id as string), ' value=', cast(value as string), '\\n')"
)
_LOG_DUCK = (
    "'/srv/app/train.py:' || cast(event_id as varchar) || ': UserWarning: ' || event_type || chr(10) || "
    "'  warnings.warn(msg)' || chr(10) || 'step ' || cast(event_id as varchar) || ' value=' || cast(value as varchar) || chr(10)"
)


@register(
    "strip_warnings",
    f"""
select event_id, trim(regexp_replace({_LOG_DUCK}, '(?m)^/.+?:\\d+:.*?Warning:.*?$\\n(?:^\\s+.*?$\\n)*', '', 'g'), {_WS}) as cleaned
from events""",
)
def strip_warnings_query(spark: SparkSession, sf: str) -> DataFrame:
    """warning blocks removed from a per-event log text, then stripped."""
    ev = table(spark, sf, "events")
    log = F.expr(_LOG_SPARK)
    return ev.select("event_id", fx.strip_warnings(log).alias("cleaned"))


@register(
    "truncate_tail",
    """
select doc_id, case when length(text) <= 4000 then text
                    else '[...' || cast(length(text) - 3920 as varchar) || ' chars truncated...]' || chr(10) || right(text, 3920) end as clipped
from documents""",
)
def truncate_tail_query(spark: SparkSession, sf: str) -> DataFrame:
    """tail truncation to 4,000 characters with the marker line."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", fx.truncate_tail("text", 4000).alias("clipped"))


@register(
    "first_line",
    f"select doc_id, substr(split_part(trim(text, {_WS}), chr(10), 1), 1, 100) as first_line from documents",
)
def first_line_query(spark: SparkSession, sf: str) -> DataFrame:
    """first line of the stripped text, 100 characters."""
    return table(spark, sf, "documents").select("doc_id", fx.first_line("text").alias("first_line"))


@register(
    "base64_roundtrip",
    "select doc_id, to_base64(encode(text)) as b64, decode(from_base64(to_base64(encode(text)))) = text as roundtrip_ok from documents",
)
def base64_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """base64 of every document's UTF-8 bytes (one line) and the decode round trip."""
    docs = table(spark, sf, "documents")
    b64 = fx.base64_text("text")
    return docs.select("doc_id", b64.alias("b64"), (fx.unbase64_text(b64) == F.col("text")).alias("roundtrip_ok"))


_PROPS = "case when substr(md5(cast(event_id as string) || ':json'), 1, 1) = '0' then 'not json' else props end"


_PROPS_SQL = f"""
select event_id, case when {_PROPS} like '{{%' then cast(json_extract({_PROPS}, '$.k') as integer) end as k,
   case when {_PROPS} like '{{%' then '{{"k":' || cast(cast(json_extract({_PROPS}, '$.k') as integer) as varchar) || '}}' end as compact
from events"""


@register("props_json", _PROPS_SQL)
def props_json(spark: SparkSession, sf: str) -> DataFrame:
    """decode a JSON object column (malformed -> NULL) and re-encode it compactly."""
    ev = table(spark, sf, "events").select("event_id", F.expr(_PROPS).alias("props"))
    obj = fx.json_object_or_null("props", "struct<k:int>")
    return ev.select("event_id", obj.getField("k").alias("k"), F.when(obj.isNotNull(), fx.compact_json(obj)).alias("compact"))


@register("props_variant", _PROPS_SQL)
def props_variant(spark: SparkSession, sf: str) -> DataFrame:
    """F14 as a variant: the field by path and the compact form, no schema given."""
    ev = table(spark, sf, "events").select("event_id", fx.variant_object_or_null(F.expr(_PROPS)).alias("v"))
    return ev.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"), F.to_json("v").alias("compact"))


@register(
    "tool_calls",
    """
with u as (select conv_id, turn, string_split(text, chr(10)) as ls from conversations where role = 'user'),
x as (select conv_id, turn, ls, unnest(generate_series(1, len(ls))) as i from u)
select conv_id, turn, cast(i - 1 as integer) as item_pos,
       'call_' || cast(conv_id as varchar) || '_' || cast(turn as varchar) || '_' || cast(i - 1 as varchar) as call_id,
       'read_file' as name, ls[i] as path
from x""",
)
def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """G1: function calls extracted from response JSON built per conversation turn."""
    resp = tr.responses_from_turns(table(spark, sf, "conversations"))
    calls = tr.extract_tool_calls(resp, "response", ["conv_id", "turn"])
    return calls.select("conv_id", "turn", "item_pos", "call_id", "name", F.col("arguments")["path"].alias("path"))


@register(
    "message_text",
    f"""
select conv_id, turn,
       case when role = 'system' and text <> '' then text
            when role = 'assistant' then trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)), {_WS})
            else '' end as answer
from conversations""",
)
def message_text(spark: SparkSession, sf: str) -> DataFrame:
    """Final text of each response (output_text, else joined message chunks)."""
    resp = tr.responses_from_turns(table(spark, sf, "conversations"))
    return resp.select("conv_id", "turn", tr.extract_text("response").alias("answer"))


@register(
    "bounded_text",
    """
select doc_id, 'doc_' || cast(doc_id as varchar) || '.txt' as name, octet_length(encode(text)) as size_bytes,
       case when octet_length(encode(text)) > 200000 then 'refused' else 'ok' end as status,
       case when octet_length(encode(text)) > 200000 then null
            when length(text) <= 12000 then text
            else '[...' || cast(length(text) - 11920 as varchar) || ' chars truncated...]' || chr(10) || right(text, 11920) end as content
from documents""",
)
def bounded_text(spark: SparkSession, sf: str) -> DataFrame:
    """Size-guarded read of every document (refuse > 200,000 B; else tail-truncate to 12,000 chars)."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size_bytes"),
        "text",
    )
    return tx.bounded_read(docs, "name", "size_bytes", "text").select("doc_id", "name", "size_bytes", "status", "content")
