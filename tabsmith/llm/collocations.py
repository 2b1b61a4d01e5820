"""Phrase collocations by an FM-index per shard over word numbers.

A shard is the text of one language in about ``SHARD_BYTES`` of one input partition.  One pass over the texts
numbers each shard's words.  Counts then go through three sums across shards, and each sum tells the shards what can
still be part of a phrase of ``LEAST`` occurrences:

1. words: a shard's words go, packed by a hash, to blocks of about ``BLOCK``, whose tasks sum them, number the frequent ones and
   answer each shard with the numbers of its own;
2. pairs: a shard's index over its frequent words (all others separate) is extended by one word; the
   pairs go to blocks in the same way, and each shard hears which of its pairs are frequent;
3. phrases of three to ``WIDTH`` words: a shard's index over the text cut at every pair that is not frequent is extended
   to the left and to the right in turn, both transforms' intervals in step, and the counts are summed in blocks.

No phrase is lost: one of ``LEAST`` occurrences has only words and pairs of as many.  The phrases' scores,
cuts and ranks are Spark joins on the summed tables.

Defined results: a null text is empty, a null lang is ``und``; words are compared as strings between shards
and by 64-bit hashes inside one; repeated rows count each; an empty table gives no rows; other columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import cut, few_rows, small_batches
from .shingles import mix64
from .word_index import WordIndex, number_words, plain_bytes

LEAST = 100
WIDTH = 5
TOP = 2000
SHARD_BYTES = 32_000_000
BLOCK = 1_000_000
SHARDS_AT_ONCE = 2
TOP_SALTS = 64
UNIT_SCHEMA = "shard long, lang string, words array<string>, counts array<long>, seq binary"
PACKED = "block long, shard long, keys binary, counts binary"
WORD_BLOCKS = "block long, shard long, lang string, words array<string>, counts array<long>, places array<long>"
WORD_SUMS = "shard long, lang string, words array<string>, f array<long>, ids array<long>, places array<long>"
VERDICT = "shard long, keys binary, a array<long>, b array<long>, f array<long>"
_U = np.uint64
_LOW = _U(32)


def _numbered(shard_bytes: int):
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[bytes]] = {}
        size, made = 0, 0
        place = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal made
            for lang, texts in sorted(held.items()):
                words, counts, seq = number_words(b"\n".join(texts))
                if words:
                    yield pd.DataFrame({"shard": [place + made], "lang": [lang], "words": [words], "counts": [counts], "seq": [seq.tobytes()]})
                    made += 1
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                raw = plain_bytes(text)
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size > shard_bytes:
                    yield from flush()
                    size = 0
        yield from flush()

    return number


def text_units(spark: SparkSession, docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: its words, their counts and the sequence of word numbers, written to the shared folder."""
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "llm-units")
    rows.mapInPandas(_numbered(shard_bytes), UNIT_SCHEMA).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(UNIT_SCHEMA).parquet(path)


def _word_blocks(blocks: int):
    def word_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                words = np.asarray(row.words, dtype=object)
                block = (mix64(pd.util.hash_array(words, categorize=False) + _U(len(row.lang))) % _U(blocks)).astype(np.int64)
                places = np.argsort(block, kind="stable")
                at, ends = _runs(block[places])
                yield pd.DataFrame(
                    {
                        "block": block[places][at],
                        "shard": row.shard,
                        "lang": row.lang,
                        "words": [words[places[i:j]] for i, j in zip(at, ends)],
                        "counts": [row.counts[places[i:j]] for i, j in zip(at, ends)],
                        "places": [places[i:j] for i, j in zip(at, ends)],
                    }
                )

    return word_blocks


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of the runs of equal values."""
    at = np.flatnonzero(np.diff(values, prepend=-1))
    return at, np.append(at[1:], len(values))


def _sum_words(blocks: int, least: int):
    def sum_words(rows: pd.DataFrame) -> pd.DataFrame:
        out, made = [], 0
        block = int(rows["block"].iloc[0])
        for lang, part in rows.groupby("lang"):
            codes, distinct = pd.factorize(np.concatenate(part["words"].tolist()))
            f = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(f, codes, np.concatenate(part["counts"].tolist()))
            often = f >= least
            ids = np.zeros(len(distinct), dtype=np.int64)
            ids[often] = (made + np.arange(often.sum())) * blocks + block + 1  # each block has numbers of its own
            made += int(often.sum())
            out.append((None, lang, distinct[often], f[often], ids[often], None))
            end = 0
            for shard, places in zip(part["shard"], part["places"]):
                start, end = end, end + len(places)
                mine = ids[codes[start:end]]
                if mine.any():
                    out.append((shard, lang, None, None, mine[mine > 0], places[mine > 0]))
        return pd.DataFrame(out, columns=["shard", "lang", "words", "f", "ids", "places"]).astype({"shard": "Int64"})

    return sum_words


def number_frequent_words(spark: SparkSession, units: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, known): (lang, word, f, id) of the words with ``least`` occurrences in their language, id from 1; and the
    shards with the places (in their list of words) and ids of their frequent words."""
    total = units.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = total // BLOCK + 1
    rows = units.select("shard", "lang", "words", "counts").mapInPandas(_word_blocks(blocks), WORD_BLOCKS)
    sums = cut(spark, rows.groupBy("block").applyInPandas(_sum_words(blocks, least), WORD_SUMS), "words")
    flat = sums.where("shard is null").select("lang", F.explode(F.arrays_zip("words", "f", "ids")).alias("w"))
    words = flat.select("lang", F.col("w.words").alias("word"), F.col("w.f").alias("f"), F.col("w.ids").alias("id"))
    lists = sums.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("places", "ids")).alias("k"))  # at most the shard's words
    lists = lists.select("shard", F.flatten("k.places").alias("places"), F.flatten("k.ids").alias("ids"))
    return words, units.select("shard", "lang", F.size("words").alias("n_words"), "seq").join(lists, "shard")


def _known_sequence(row) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, ids): the text in numbers 1.. of its frequent words (ids in their order), 0 for all else."""
    ids = np.asarray(row.ids, dtype=np.int64)
    order = np.argsort(ids)
    number = np.zeros(row.n_words + 1, dtype=np.int32)
    number[np.asarray(row.places, dtype=np.int64)[order] + 1] = np.arange(1, len(ids) + 1)
    seq = number[np.frombuffer(row.seq, dtype=np.int32)]
    return _squeezed(seq), np.concatenate([[0], ids[order]])


def _squeezed(seq: np.ndarray) -> np.ndarray:
    """Runs of separators as one."""
    return seq[(seq > 0) | np.append(True, seq[:-1] > 0)] if len(seq) else seq


def _pair_keys(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (ids[a].astype(_U) << _LOW) | ids[b].astype(_U)


def _pairs(blocks: int):
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                seq, ids = _known_sequence(row)
                index = WordIndex(seq, len(ids), 2)
                found, _, counts = index.extend(*index.words(), right=False)
                keys = _pair_keys(ids, found[:, 0], found[:, 1])
                if not len(keys):
                    continue
                block = (mix64(keys.copy()) % _U(blocks)).astype(np.int64)
                order = np.lexsort((keys, block))
                keys, counts, block = keys[order], counts[order].astype(np.uint32), block[order]
                at, ends = _runs(block)
                yield pd.DataFrame(
                    {
                        "block": block[at],
                        "shard": row.shard,
                        "keys": [keys[i:j].tobytes() for i, j in zip(at, ends)],
                        "counts": [counts[i:j].tobytes() for i, j in zip(at, ends)],
                    }
                )

    return pairs


def _sum_block(least: int):
    def sum_block(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, dtype=_U) for k in rows["keys"]]
        counts = np.concatenate([np.frombuffer(c, dtype=np.uint32) for c in rows["counts"]]).astype(np.int64)
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        f = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(f, where, counts)
        often = f >= least
        a, b = (distinct[often] >> _LOW).astype(np.int64), (distinct[often] & _U(0xFFFFFFFF)).astype(np.int64)
        out = [(None, None, a, b, f[often])]
        end = 0
        for shard, k in zip(rows["shard"], keys):
            start, end = end, end + len(k)
            mine = k[often[where[start:end]]]
            if len(mine):
                out.append((shard, mine.tobytes(), None, None, None))
        return pd.DataFrame(out, columns=["shard", "keys", "a", "b", "f"]).astype({"shard": "Int64"})

    return sum_block


def _phrases(width: int, blocks: int):
    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                seq, ids = _known_sequence(row)
                allowed = np.sort(np.concatenate([np.frombuffer(k, dtype=_U) for k in row.pairs]))
                a, b = seq[:-1], seq[1:]
                keys = _pair_keys(ids, a, b)
                at = np.minimum(np.searchsorted(allowed, keys), len(allowed) - 1)
                tied = (a > 0) & (b > 0) & (allowed[at] == keys)
                # a word stays if it is in two tied pairs in a row; between words whose pair is not tied comes a separator
                chain = tied[:-1] & tied[1:]
                stays = np.zeros(len(seq), dtype=bool)
                for k in range(3):
                    stays[k : k + len(chain)] |= chain
                broken = np.flatnonzero(stays & np.append(~tied, True)) + 1
                seq = _squeezed(np.insert(np.where(stays, seq, 0), broken, 0))
                there = np.unique(seq)
                there = there[there > 0]
                local = np.searchsorted(np.concatenate([[0], there]), seq)
                ids = np.concatenate([[0], ids[there]])
                index = WordIndex(local, len(ids), width)
                found, keys, counts = index.words(), [], []
                for n in range(2, width + 1):
                    found = index.extend(*found, right=n % 2 == 1)
                    if n > 2:
                        keys.append(np.pad(ids[found[0]].astype(np.uint32), ((0, 0), (0, width - n))))
                        counts.append(found[2].astype(np.uint32))
                keys, counts = np.concatenate(keys), np.concatenate(counts)
                if not len(keys):
                    continue
                mixed = np.zeros(len(keys), dtype=_U)
                for k in range(width):
                    mixed = mix64(mixed ^ keys[:, k].astype(_U))
                block = (mixed % _U(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                keys, counts, block = keys[order], counts[order], block[order]
                at, ends = _runs(block)
                yield pd.DataFrame(
                    {
                        "block": block[at],
                        "keys": [keys[i:j].tobytes() for i, j in zip(at, ends)],
                        "counts": [counts[i:j].tobytes() for i, j in zip(at, ends)],
                    }
                )

    return phrases


def _sum_phrases(width: int, least: int):
    def sum_phrases(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.concatenate([np.frombuffer(c, dtype=np.uint32) for c in rows["counts"]]).astype(np.int64)
        keys = np.frombuffer(b"".join(rows["keys"]), dtype=np.dtype((np.void, 4 * width)))
        distinct, where = np.unique(keys, return_inverse=True)
        f = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(f, where, counts)
        often = f >= least
        ids = np.frombuffer(distinct[often].tobytes(), dtype=np.uint32).reshape(-1, width).astype(np.int64)
        return pd.DataFrame({"ids": pd.Series([x[x > 0] for x in ids], dtype=object), "f": f[often]})

    return sum_phrases


def frequent_phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): frequent words with ids; n of each lang; (lang, ids, f) of all phrases of up to ``width`` words with ``least`` occurrences."""
    units = text_units(spark, docs, shard_bytes)
    with few_rows(spark, SHARDS_AT_ONCE):
        words, known = number_frequent_words(spark, units, least)
    count = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    totals = cut(spark, units.groupBy("lang").agg(F.sum(count).alias("n")), "totals")
    size = words.agg(F.sum("f"), F.max("id")).first()
    if (size[1] or 0) >= 1 << 32:
        raise ValueError("more than 2^32 frequent words: two of them no longer fit into one 64-bit key")
    blocks = (size[0] or 0) // BLOCK + 1
    packed = known.mapInPandas(_pairs(blocks), PACKED)
    with few_rows(spark, SHARDS_AT_ONCE):
        verdicts = cut(spark, packed.groupBy("block").applyInPandas(_sum_block(least), VERDICT), "pairs")
    pairs = verdicts.where("shard is null").select(F.explode(F.arrays_zip("a", "b", "f")).alias("p"))
    answer = verdicts.where("shard is not null").groupBy("shard").agg(F.collect_list("keys").alias("pairs"))  # at most the shard's pairs
    occurrences = pairs.agg(F.sum("p.f")).first()[0] or 0
    rows = known.join(answer, "shard").mapInPandas(_phrases(width, occurrences // BLOCK + 1), "block long, keys binary, counts binary")
    longer = rows.groupBy("block").applyInPandas(_sum_phrases(width, least), "ids array<long>, f long")
    many = pairs.select(F.array("p.a", "p.b").alias("ids"), F.col("p.f").alias("f")).union(longer)
    many = many.join(words.select("id", "lang"), F.col("ids")[0] == F.col("id")).select("lang", "ids", "f")
    single = words.select("lang", F.array("id").alias("ids"), "f")
    with few_rows(spark, SHARDS_AT_ONCE):
        return words, totals, cut(spark, single.union(many), "phrases")


def _lowest_cut(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(ids, lang, a, l, r, n, score) of every phrase of two words or more, by its lowest-scoring cut."""
    part = lambda name: phrases.select(F.col("ids").alias(f"{name}_ids"), F.col("f").alias(name))
    many = phrases.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    cuts = many.select("*", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"l_ids": F.slice("ids", 1, F.col("k")), "r_ids": F.expr("slice(ids, k + 1, size(ids) - k)")})
    cuts = cuts.join(part("l"), "l_ids").join(part("r"), "r_ids").join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(38,0)) * n * 1000) div (cast(l as decimal(38,0)) * r)").cast("long"))
    best = F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best")
    return cuts.groupBy("lang", "ids").agg(best).select("lang", "ids", "best.*")


def _inside_longer(phrases: DataFrame) -> DataFrame:
    """(ids, most): the largest count of a phrase with one word more at either end.

    Longer ones add nothing: a phrase between two of equal counts has that count too.
    """
    long = phrases.where(F.size("ids") > 2)
    ends = F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))
    return long.select("f", F.explode(ends).alias("ids")).groupBy("ids").agg(F.max("f").alias("most"))


def collocation_report(
    spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = WIDTH, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    words, totals, phrases = frequent_phrases(spark, docs, least, width, shard_bytes)
    scored = _lowest_cut(phrases, totals).join(_inside_longer(phrases), "ids", "left")
    scored = scored.where(F.col("most").isNull() | (F.col("most") < F.col("a")))
    flat = scored.select("lang", "ids", "a", "l", "r", "n", "score", F.posexplode("ids").alias("place", "id"))
    spelled = flat.join(words.select("id", "word"), "id").groupBy("lang", "ids", "a", "l", "r", "n", "score")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    rows = spelled.agg(phrase.alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(TOP_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    final = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return final.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


REPORT_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
grams as (
    select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
    from w, (select unnest(range(1, 6)) as k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 100),
closed as (
    select distinct x.lang, part from (
        select c.lang, c.a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) as part from c where k > 2) x
    join c as short on short.lang = x.lang and short.phrase = x.part and 100 * x.a >= 100 * short.a),
cuts as (
    select c.lang, c.phrase, c.a, cut, l.f as l, r.f as r, n,
           (1000::hugeint * c.a * n) // (l.f::hugeint * r.f) as score
    from (select *, unnest(range(1, k)) as cut from c) c
    join f as l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:cut], ' ')
    join f as r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
    join totals on totals.lang = c.lang),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
kept as (select lowest.* from lowest left join closed on closed.lang = lowest.lang and closed.part = lowest.phrase where closed.part is null),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
       cast(n as bigint) as n, cast(score as bigint) as score
from ranked where rank <= 2000
"""
