"""Access to the test tables and the fixture views built on them.

Fixture views are plain SQL that both Spark SQL and DuckDB accept, so the same
text defines the Spark input and the oracle input.  They never shrink the data:
a view either covers its whole base table, or it is one side of a hash holdout
whose two sides together cover the whole table (train / test).  The base tables
contain no NULLs, so some views inject them at hash-chosen rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def _holdout(key: str) -> str:
    # 3 of 16 md5 buckets -> about 19 % of the rows are the test side.
    return f"substr(md5(cast({key} as string) || ':holdout'), 1, 1) in ('0', '1', '2')"


def _hash_hit(key: str, salt: str) -> str:
    # about 1 row in 16, chosen by hash (identical in Spark and DuckDB).
    return f"substr(md5(cast({key} as string) || ':{salt}'), 1, 1) = '0'"


FIXTURE_SQL: dict[str, str] = {
    # orders: regression target o_totalprice, multiclass target o_orderstatus.
    "v_orders_train": f"""
        select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice
        from orders where not ({_holdout('o_orderkey')})""",
    "v_orders_test": f"""
        select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate
        from orders where {_holdout('o_orderkey')}""",
    # Whole-table QA inputs: the template and the test cover every order.
    "v_orders_all_test": """
        select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate from orders""",
    "v_orders_template": """
        select o_orderkey, cast(0.5 as double) as o_totalprice from orders""",
    "v_orders_submission": """
        select o_orderkey, o_totalprice * 0.9 + 1.0 as prediction from orders""",
    # A broken submission: ids replaced by customer keys (duplicates) and
    # hash-chosen NULL predictions.
    "v_orders_bad": f"""
        select o_custkey as o_orderkey,
               case when {_hash_hit('o_orderkey', 'null')} then null else cast(1 as double) end as o_totalprice
        from orders""",
    # documents with quality labels: binary target, text-heavy.
    "v_docs_train": f"""
        select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality
        from documents d join labels l on d.doc_id = l.doc_id where not ({_holdout('d.doc_id')})""",
    "v_docs_test": f"""
        select d.doc_id, d.text, d.lang, d.source, d.n_chars
        from documents d join labels l on d.doc_id = l.doc_id where {_holdout('d.doc_id')}""",
    # events with injected NULLs and unparseable timestamps.
    "v_events": f"""
        select event_id, user_id,
               case when {_hash_hit('event_id', 'ts')} then 'bad' else cast(ts as string) end as ts_text,
               case when {_hash_hit('event_id', 'value')} then null else value end as value,
               case when {_hash_hit('event_id', 'type')} then null else event_type end as event_type,
               props
        from events""",
    "v_events_train": f"""
        select event_id, user_id,
               case when {_hash_hit('event_id', 'ts')} then 'bad' else cast(ts as string) end as ts_text,
               case when {_hash_hit('event_id', 'value')} then null else value end as value,
               case when {_hash_hit('event_id', 'type')} then null else event_type end as event_type,
               props
        from events where not ({_holdout('event_id')})""",
    "v_events_test": f"""
        select event_id, user_id,
               case when {_hash_hit('event_id', 'ts')} then 'bad' else cast(ts as string) end as ts_text,
               case when {_hash_hit('event_id', 'value')} then null else value end as value,
               case when {_hash_hit('event_id', 'type')} then null else event_type end as event_type,
               props
        from events where {_holdout('event_id')}""",
    "v_customer": """
        select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer""",
    "v_lineitem": """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax,
               l_returnflag, l_linestatus, l_extendedprice from lineitem""",
}

_WORD = re.compile(r"\b([a-z_]+)\b")


def _base_tables(sql: str) -> list[str]:
    words = set(_WORD.findall(sql.lower()))
    return [t for t in TABLES if t in words]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql_over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL whose table names are the test tables, binding each name to its
    DataFrame through ``spark.sql(..., name=df)`` (private views; the session's
    own temp views are left untouched)."""
    names = _base_tables(sql)
    text = re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: "{" + m.group(1) + "}", sql) if names else sql
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql_over_tables(spark, sf_dir, FIXTURE_SQL[name])


def with_views(body: str, *names: str) -> str:
    """Prefix an oracle query with the fixture views it reads, as CTEs."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n].strip()})" for n in names)
    return f"with {ctes}\n{body}"
