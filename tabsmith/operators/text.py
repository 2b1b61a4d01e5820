"""Text operators: TF-IDF in relational form (E7, A17, L8) and bounded text reads.

Tokens are runs of two or more Unicode letters/digits/underscores of the
lowercased text (the Unicode meaning of ``\\b\\w\\w+\\b``); terms are unigrams
and space-joined bigrams.  The vocabulary is the ``max_features`` terms with the
largest corpus count (ties by term), indexed alphabetically; idf is the smoothed
``ln((1 + n) / (1 + df)) + 1``; document vectors are L2-normalised.

Terms are counted as numbers inside tasks (``term_counts``); what leaves a task is one row per
distinct term it saw, or one row per document with its counts.  The vocabulary is a bounded
top-k (5,000 rows, safe to send to every task), and normalisation groups by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import TOKEN_PATTERN, truncate_tail
from ..session import scratch_path, ship_package, small_batches
from . import term_counts as tc
from .quality import q

# Fixed values of the reference's TF-IDF preset.
MAX_FEATURES = 5000
NGRAM_MAX = 2
# Tokens that the second pass of the vocabulary takes along at most (max_features and their ties); beyond, all terms are counted.
MAX_FREQUENT = 200_000
# Fixed values of the bounded file read.
READ_SIZE_LIMIT_BYTES = 200_000
READ_CSV_SIZE_LIMIT_BYTES = 50_000
MAX_READ_CHARS = 50_000
DEFAULT_READ_CHARS = 12_000
MIN_READ_CHARS = 200


def tokens(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def terms(token_col: str | Column) -> Column:
    """Unigrams followed by bigrams of a token array.

    The neighbours are paired by ``zip_with`` over two slices: an index into the array inside a lambda
    would evaluate the array's own expression once per token.
    """
    t = F.col(token_col) if isinstance(token_col, str) else token_col
    pairs = F.greatest(F.size(t) - 1, F.lit(0))
    return F.concat(t, F.zip_with(F.slice(t, F.lit(1), pairs), F.slice(t, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b)))


def _term_rows(df: DataFrame, key: str, text_col: str) -> DataFrame:
    return df.select(q(key), tokens(q(text_col)).alias("_toks")).select(q(key), terms("_toks").alias("_terms"))


def joined_tokens(text: str | Column) -> Column:
    """The tokens of a text with a space between them, as ``term_counts`` reads them."""
    return F.array_join(tokens(text), " ")


def doc_terms(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term, tf) -- raw count of each term in each document (whole texts), combined before the shuffle."""
    exploded = _term_rows(df, key, text_col).select(q(key), F.explode("_terms").alias("term"))
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(df: DataFrame, text_col: str, most: int | None = None) -> DataFrame:
    """(term, corpus_tf, doc_freq) of every unigram and bigram, or of at least the ``most`` most frequent ones with their ties.

    Terms are counted within each task; one shuffle by term adds the counts up.
    """
    spark = df.sparkSession
    ship_package(spark)
    small_batches(spark)
    rows = df.select(joined_tokens(q(text_col)).alias("_toks"))
    count = _frequent_counter(rows, most) if most is not None else tc.count_terms
    counts = rows.mapInArrow(count, "term string, corpus_tf long, doc_freq long")
    return counts.groupBy("term").agg(F.sum("corpus_tf").alias("corpus_tf"), F.sum("doc_freq").alias("doc_freq"))


def _frequent_counter(rows: DataFrame, most: int):
    """The task of the second pass (see ``term_counts``), or that for all terms when the first pass rules none out."""
    spark = rows.sparkSession
    path = scratch_path(spark, "terms")
    sketch = "term string, tf long, slice int, sums binary"
    rows.mapInArrow(tc.sketch_terms, sketch).write.parquet(path)
    first = spark.read.schema(sketch).parquet(path)
    words = first.where("term is not null").groupBy("term").agg(F.sum("tf").alias("tf"))
    top = words.orderBy(F.desc("tf")).limit(most).agg(F.min("tf").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if top["n"] < most or top["least"] < 2:
        return tc.count_terms
    frequent = [r["term"] for r in words.where(F.col("tf") >= top["least"]).select("term").limit(MAX_FREQUENT + 1).toLocalIterator()]
    if len(frequent) > MAX_FREQUENT:  # ties at the bound
        return tc.count_terms
    slices = first.where("slice is not null").select("slice", "sums").repartition(tc.SLICES, "slice")
    bits = {r["slice"]: bytes(r["bits"]) for r in slices.mapInArrow(tc.frequent_buckets(top["least"]), "slice int, bits binary").collect()}  # BUCKETS / 8 bytes
    return tc.count_frequent(frequent, bits)


def tfidf_vocabulary(df: DataFrame, key: str, text_col: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """A17 + L8: (term, corpus_tf, doc_freq, idf, term_index) for the top ``max_features`` terms."""
    n_docs = df.count()
    top = term_statistics(df, text_col, max_features).orderBy(F.desc("corpus_tf"), F.asc("term")).limit(max_features)
    idf = F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("doc_freq"))) + F.lit(1.0)
    # the vocabulary is at most max_features rows: the window and later broadcasts are bounded.
    return top.select(
        "term",
        "corpus_tf",
        "doc_freq",
        idf.alias("idf"),
        (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("term_index"),
    )


def tfidf_weights(df: DataFrame, key: str, text_col: str, vocab: DataFrame) -> DataFrame:
    """E7 transform: (key, term, term_index, weight) with L2-normalised tf * idf per document.

    ``vocab`` (a row per term, ``max_features`` rows) goes to every task.  A row's counts of its terms travel as two
    lists, so the one shuffle by key moves a row per document; rows of one key are one document, a null key none.
    """
    spark = df.sparkSession
    ship_package(spark)
    small_batches(spark)
    voc = vocab.select("term", "idf", "term_index").orderBy("term_index").toArrow().combine_chunks()
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("term", T.StringType()), T.StructField("term_index", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    lists = T.StructType([out["key"], *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "counts"))])
    rows = df.where(q(key).isNotNull()).select(q(key).alias("key"), joined_tokens(q(text_col)).alias("_toks"))
    at = voc.column("term_index").to_numpy()
    idf, names = np.zeros(int(at.max()) + 1 if len(at) else 1), [""] * (int(at.max()) + 1 if len(at) else 1)
    for i, term, weight in zip(at.tolist(), voc.column("term").to_pylist(), voc.column("idf").to_pylist()):
        names[i], idf[i] = term, weight
    found = rows.mapInArrow(tc.find_terms(tc.TermIndex(voc.column("term").to_pylist(), at.tolist())), lists)
    whole = found.repartition("key").sortWithinPartitions("key").mapInArrow(tc.weigh_keys(pa.array(names, pa.string()), idf), out)
    return whole.select(F.col("key").alias(key), "term", "term_index", "weight")


def bounded_read(
    df: DataFrame,
    name_col: str,
    size_col: str,
    text_col: str,
    max_chars: int = DEFAULT_READ_CHARS,
) -> DataFrame:
    """S5 over a table of files: refuse .csv above 50,000 B and anything above
    200,000 B; otherwise return the text tail-truncated to max(200, min(max_chars, 50,000))."""
    limit = max(MIN_READ_CHARS, min(max_chars, MAX_READ_CHARS))
    is_csv = F.lower(q(name_col)).endswith(".csv")
    refused = (is_csv & (q(size_col) > READ_CSV_SIZE_LIMIT_BYTES)) | (q(size_col) > READ_SIZE_LIMIT_BYTES)
    return df.select(
        "*",
        F.when(refused, F.lit("refused")).otherwise(F.lit("ok")).alias("status"),
        F.when(~refused, truncate_tail(q(text_col), limit)).alias("content"),
    )
