"""Language identification by n-gram filters with one bit per language.

Learning counts the hashed n-grams of letters (orders 1 to ``N``) of every training text by language, over
the whole corpus.  An n-gram belongs to every language that has it, unless it is rarer there by ``MAX_RATIO``
than in the language that uses it most.  All n-grams enter as long as they fit: the slots are sized from their
measured number, up to ``MAX_GRAMS`` n-grams and ``MAX_BYTES`` of masks; beyond that all single letters and the
n-grams of the largest shares do, and the others are told by the shorter n-grams in them.  The languages of each
n-gram are one bitmask (several words beyond 64 languages), and a bit-sliced Bloom filter stores the masks: each of
``HASHES`` slots of an n-gram takes the mask by OR, a lookup is the AND of its slots and returns all languages
containing the n-gram.

At each place of a text the n-gram of order N is looked up and, while no language has it, the next shorter one
within it.  The bits are counted per language and corrected for the filter's false positives (the share of slots
with the language's bit, to the power HASHES).  The language of the largest corrected count wins, the first by name
on a tie; the score is that count's share of the text's places, from 0 to 1.

Defined results: a null text and one without a letter is ``und`` with score 0; one with letters but without any
n-gram of a learned language gets the language learned from the most n-grams, with score 0; without any training row every text is ``und``; rows with a null language are not learned from;
repeated rows count as often as they occur; other columns are left alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, cut, small_batches, text_chunks

UNDETERMINED = "und"
N = 4
HASHES = 2
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
CHUNK = 200_000  # characters a step: the arrays stay in the processor's cache
MAX_RATIO = 20.0
WORD = 64  # languages in a word of a mask
MAX_GRAMS = 1 << 22
MAX_BYTES = 1 << 27
FLUSH = 400_000


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter, and its lower-case form (0 for all but letters)."""
    chars = [chr(c) for c in range(sys.maxunicode + 1)]
    letter = np.fromiter((c.isalpha() for c in chars), dtype=bool, count=len(chars))
    lower = np.zeros(len(chars), dtype=np.uint32)
    for c in np.flatnonzero(letter):
        low = chars[c].lower()
        lower[c] = ord(low) if len(low) == 1 else c
    return letter, lower


def _hash(seq: np.ndarray, first: int, n: int, m: int) -> np.ndarray:
    """The hashes of the n-grams at first, first + 1, ... of m places."""
    h = np.zeros(m, dtype=np.uint32)
    for k in range(first, first + n):
        h *= np.uint32(0x9E3779B1)
        h += seq[k : k + m]
        h ^= h >> np.uint32(15)
    return h


def ngrams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, has_letter): text i's n-gram hashes are hashes[bounds[i]:bounds[i+1]].

    Runs of other characters are one blank; blanks stand around each text, so a single letter has n-grams.
    """
    h, bounds, has_letter = _places(texts, n)
    return h[0], bounds, has_letter


def _places(texts: list[str], n: int = N) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As ngrams, with the hashes of the n-gram of each place and of the shorter ones within it, down to its (n - 1)-th character.

    With n - 2 blanks around a text, every letter stands as the last but one of some place.  Blanks alone have hash 0.
    """
    letter, lower = _letters()
    pad = " " * (n - 2)
    joined = "".join([pad + t + pad for t in texts])
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.array([len(t) + 2 * (n - 2) for t in texts], dtype=np.int64))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.empty(0, np.int64)
    low = lower[cps]
    is_letter = low != 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first blank after a letter
    for k in range(n - 2):  # the blanks around the texts
        keep[starts + k] = True
        keep[ends - 1 - k] = True
    pos = np.flatnonzero(keep)
    seq = low[pos]
    lo, hi = np.searchsorted(pos, starts), np.searchsorted(pos, ends)
    m = max(len(seq) - n + 1, 0)
    letters_at = np.flatnonzero(is_letter)
    has_letter = np.searchsorted(letters_at, ends) > np.searchsorted(letters_at, starts)
    if not m:
        return [np.empty(0, np.uint32)] * n, np.zeros(len(texts) + 1, np.int64), has_letter
    valid = np.ones(m, dtype=bool)
    for k in range(1, n):  # no n-gram reaches over the end of a text
        at = hi - k
        valid[at[(at >= lo) & (at < m)]] = False
    some = seq[:m] != 0
    for k in range(1, n):  # n-grams of blanks alone say nothing
        some |= seq[k : k + m] != 0
    valid &= some
    before = np.concatenate([[0], np.cumsum(valid)])
    bounds = np.concatenate([before[np.minimum(lo, m)], [before[-1]]])
    hashes = [_hash(seq, 0, n, m)[valid]]
    hashes += [_hash(seq, n - 1 - order, order, m)[valid] for order in range(n - 1, 0, -1)]
    return hashes, bounds, has_letter


def slots_of(h: np.ndarray, k: int, bits: int = SLOT_BITS) -> np.ndarray:
    return (h * np.uint32((0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)[k])) >> np.uint32(32 - bits)


def mask_type(languages: int) -> type:
    """The smallest word that holds the languages; several of the widest beyond it."""
    return next((t for t in (np.uint8, np.uint16, np.uint32) if languages <= np.iinfo(t).bits), np.uint64)


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # one bitmask of languages per slot, or a row of words
    prior: str = UNDETERMINED  # what a text with letters is taken for if none of its n-grams is known: the language learned from most

    def __post_init__(self):
        self.masks = self.masks.astype(mask_type(len(self.languages)), copy=False)  # small masks stay in the processor's cache
        self.bits = len(self.masks).bit_length() - 1
        filled = np.array([np.count_nonzero(self._has(self.masks, b)) for b in range(len(self.languages))])
        self.false_rate = (filled / len(self.masks)) ** HASHES

    def _has(self, found: np.ndarray, b: int) -> np.ndarray:
        return ((found if found.ndim == 1 else found[:, b // WORD]) & self.masks.dtype.type(1 << b % WORD)) != 0

    def lookup(self, h: np.ndarray) -> np.ndarray:
        found = self.masks[slots_of(h, 0, self.bits)]
        for k in range(1, HASHES):
            found &= self.masks[slots_of(h, k, self.bits)]
        return found

    def _longest(self, hashes: list[np.ndarray]) -> np.ndarray:
        """The languages of the longest n-gram of each place that any language has."""
        found = self.lookup(hashes[0])
        for h in hashes[1:]:
            none = np.flatnonzero((found == 0 if found.ndim == 1 else ~found.any(axis=1)) & (h != 0))
            if len(none):
                found[none] = self.lookup(h[none])
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        return self.predict_lettered(texts)[:2]

    def predict_lettered(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether a text has a letter."""
        hashes, bounds, has_letter = _places(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), has_letter.tolist()
        found = self._longest(hashes)
        total = np.diff(bounds)
        best, most = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), -np.inf)
        known = np.zeros(len(texts), dtype=bool)
        for b in range(len(self.languages)):
            hits = np.concatenate([[0], np.cumsum(self._has(found, b), dtype=np.int32)])
            raw = hits[bounds[1:]] - hits[bounds[:-1]]
            count = (raw - total * self.false_rate[b]) / (1 - self.false_rate[b])
            known |= raw > 0
            more = (raw > 0) & (count > most)  # the first by name on a tie
            best[more], most[more] = b, count[more]
        known &= has_letter
        score = np.where(known, np.clip(most / np.maximum(total, 1), 0, 1), 0.0)
        unseen = np.where(has_letter, self.prior, UNDETERMINED)
        pred = [self.languages[b] if ok else str(other) for b, ok, other in zip(best, known, unseen, strict=True)]
        return pred, score.tolist(), has_letter.tolist()


def _count_ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, h, single, n) partial counts, single for letters alone; a worker holds at most about FLUSH counted n-grams per language run."""
    held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        for (lang, single), parts in held.items():
            h, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "h": h.astype(np.int64), "single": single, "n": n})

    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=False):
            for chunk in text_chunks([t or "" for t in rows["text"].tolist()], CHUNK * 5):
                orders = list(zip(*(_places(c)[0] for c in text_chunks(chunk, CHUNK)), strict=True))
                for single, parts in ((False, [p for o in orders[:-1] for p in o]), (True, orders[-1])):
                    h, n = np.unique(np.concatenate(parts), return_counts=True)
                    held.setdefault((lang, single), []).append((h[h != 0], n[h != 0]))
                    size += len(h)
                if size > FLUSH * 8:
                    yield from flush()
                    held, size = {}, 0
    yield from flush()


def learn(docs: DataFrame) -> LanguageFilter:
    """The filter of the languages in rows (text, lang); at most MAX_GRAMS masks come to the driver, in MAX_BYTES of slots."""
    small_batches(docs.sparkSession)
    rows = docs.select("text", "lang").where("lang is not null")
    counts = rows.mapInPandas(_count_ngrams, "lang string, h long, single boolean, n long")
    counts = counts.groupBy("lang", "h").agg(F.sum("n").alias("n"), F.max("single").alias("single"))
    spark = docs.sparkSession
    counts = cut(spark, counts, "langid")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], np.zeros(SLOTS, dtype=np.uint8))
    words = -(-len(languages) // WORD)
    known = spark.createDataFrame([(lang, b, float(totals[lang])) for b, lang in enumerate(languages)], "lang string, bit int, total double")
    shares = counts.join(F.broadcast(known), "lang").select("h", "bit", "single", (F.col("n") / F.col("total")).alias("share"))
    grams = shares.groupBy("h").agg(  # one entry a language
        F.collect_list(F.struct("bit", "share")).alias("in"), F.max("share").alias("most"), F.max("single").alias("single")
    )
    rank = F.when(F.col("single"), F.lit(0)).otherwise(F.ceil(F.log2("most") * -16).cast("int") + 1)  # steps of a 16th of an octave
    grams = grams.select("h", "in", "most", rank.alias("rank"))
    most_bits = (MAX_BYTES // (np.dtype(mask_type(len(languages))).itemsize * words)).bit_length() - 1
    room = min(MAX_GRAMS, (1 << most_bits) // 8)
    taken, last = 0, -1
    for r in grams.groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").collect():  # a row for each step
        if taken and taken + r["n"] > room:
            break
        taken, last = taken + r["n"], r["rank"]
    bits = min(most_bits, max(SLOT_BITS, (16 * taken).bit_length()))
    own = F.filter("in", lambda x: x["share"] * MAX_RATIO >= F.col("most"))
    word = lambda w: F.aggregate(
        F.filter(own, lambda x: F.floor(x["bit"] / WORD) == w),
        F.lit(0).cast("long"),
        lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"] % WORD)),
    )
    masks = np.zeros((1 << bits, words), dtype=mask_type(len(languages)))
    kept = grams.where(F.col("rank") <= last).select("h", *(word(w).alias(f"w{w}") for w in range(words)))
    for r in kept.toArrow().to_batches():
        h = r.column("h").to_numpy().astype(np.uint32)
        for w in range(words):
            m = r.column(f"w{w}").to_numpy().view(np.uint64).astype(masks.dtype)
            for k in range(HASHES):
                np.bitwise_or.at(masks[:, w], slots_of(h, k, bits), m)
    prior = min(languages, key=lambda lang: (-totals[lang], lang))
    return LanguageFilter(languages, masks[:, 0].copy() if words == 1 else masks, prior)


def _predictor(shared: Broadcast):
    @F.pandas_udf("lang_pred string, score double, lettered boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pred, score, lettered = [], [], []
            for chunk in text_chunks([t or "" for t in batch.tolist()], CHUNK):
                p, s, has = shared.value.predict_lettered(chunk)
                pred += p
                score += s
                lettered += has
            yield pd.DataFrame({"lang_pred": pred, "score": score, "lettered": lettered})

    return predict


def predict_column(spark: SparkSession, model: LanguageFilter, text: Column) -> Column:
    """struct(lang_pred, score, lettered); the filter's size is bounded (MAX_BYTES), so it is broadcast."""
    small_batches(spark)
    return _predictor(spark.sparkContext.broadcast(model))(text)


def held_out(key: str = "doc_id") -> Column:
    return crc_fold(F.col(key), 4) == 2


def language_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: predicted language and score, learned from the rows that are not held out."""
    model = learn(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), predict_column(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known_languages(spark: SparkSession, docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The documents (all columns) whose language is determined with a score above ``min_score``, and those with letters but
    without evidence for any language (score 0): n-grams that are merely unseen are no reason to drop a text."""
    mark = "__langid_found"
    model = learn(docs.where(~held_out()))
    found = docs.withColumn(mark, predict_column(spark, model, F.col("text")))
    return found.where((F.col(mark)["score"] > min_score) | (F.col(mark)["lettered"] & (F.col(mark)["score"] == 0))).drop(mark)
