"""Counts of unigrams and bigrams of token lists, as arrays inside tasks (the shared step of TF-IDF's fit and transform).

A row gives its tokens joined by spaces (no token holds one).  A task numbers the distinct tokens, so that a term is a
number: counting is a sort of numbers, and only what leaves the task is written out as text.

The most frequent terms are found exactly in two passes.  The first counts the tokens, and the bigrams in BUCKETS
hashed sums; the least count of the wanted number of tokens is then a bound that no wanted term falls below.
The second counts the tokens that reach it, and the bigrams of two such tokens whose bucket reaches it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HELD = 3_000_000  # (term, count) entries a task holds before it merges them
WORDS = 1_000_000  # distinct tokens a task numbers before it starts anew
CHUNK_BYTES = 8_000_000
COUNTS = pa.schema([("term", pa.string()), ("corpus_tf", pa.int64()), ("doc_freq", pa.int64())])
BUCKETS, SLICES = 1 << 21, 16
SKETCH = pa.schema([("term", pa.string()), ("tf", pa.int64()), ("slice", pa.int32()), ("sums", pa.binary())])
_LOW = (1 << 32) - 1


def row_chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive rows of about CHUNK_BYTES; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        yield start, end
        start = end


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, number of each token, its row); a null or empty text has none."""
    rows = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    lists = pc.split_pattern(texts.take(pa.array(rows, pa.int64())), " ")
    coded = lists.flatten().dictionary_encode()
    row = np.repeat(rows, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return [keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values)]


def _chunk_counts(ids: np.ndarray, row: np.ndarray, n_words: int, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, corpus_tf, doc_freq) of the terms of some rows; a code is second + 1, or that and (first + 1) * (n_words + 1)."""
    assert (n_words + 1) ** 2 * n_rows < 1 << 63
    same = row[1:] == row[:-1]
    pairs = ((ids[:-1] + 1) * (n_words + 1) + ids[1:] + 1)[same]
    keys = np.concatenate([(ids + 1) * n_rows + row, pairs * n_rows + row[1:][same]])
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    tf = np.diff(np.append(starts, len(keys)))
    return tuple(_sums(keys[starts] // n_rows, tf, np.ones(len(tf), np.int64)))


def _term_rows(words: pa.Array, code: np.ndarray, tf: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """COUNTS rows of codes (first + 1) << 32 | second + 1, the number 0 standing for no word."""
    for at in range(0, len(code), 200_000):
        part = code[at : at + 200_000]
        first, second = (part >> 32) - 1, (part & _LOW) - 1
        last = words.take(pa.array(second))
        both = pc.binary_join_element_wise(words.take(pa.array(np.maximum(first, 0))), last, " ")
        yield pa.RecordBatch.from_arrays([pc.if_else(pa.array(first >= 0), both, last), pa.array(tf[at : at + 200_000]), pa.array(df[at : at + 200_000])], schema=COUNTS)


class _Counter:
    """Counts of a task by code, with the task's own token numbers."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, texts: pa.Array) -> None:
        words, ids, row = split_tokens(texts)
        code, tf, df = _chunk_counts(ids, row, len(words), max(len(texts), 1))
        known = np.array([-1] + [self.index.setdefault(w, len(self.index)) for w in words.to_pylist()], dtype=np.int64)
        first, second = np.divmod(code, len(words) + 1)
        self.parts.append([((known[first] + 1) << 32) | (known[second] + 1), tf, df])
        self.size += len(code)

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_sums(*(np.concatenate(p) for p in zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        words = pa.array(self.index, pa.string())
        for part in self.parts:
            yield from _term_rows(words, *part)
        self.__init__()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one column of joined tokens to rows (term, corpus_tf, doc_freq) whose sums by term are the corpus's."""
    counter = _Counter()
    for batch in batches:
        texts = batch.column(0)
        for start, end in row_chunks(texts):
            counter.add(texts.slice(start, end - start))
            if counter.size > HELD:
                counter.merge()
            if counter.size > HELD // 2 or len(counter.index) > WORDS:
                counter.merge()
                if counter.size > HELD // 2 or len(counter.index) > WORDS:
                    yield from counter.flush()
    yield from counter.flush()


def word_codes(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)


def pair_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bucket of each pair of word codes."""
    x = (first << np.uint64(32)) | second
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def sketch_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one column of joined tokens to SKETCH rows: counts of tokens, and the bigrams' sums by slices of the buckets."""
    index: dict[str, int] = {}
    parts: list[np.ndarray] = []
    sums = np.zeros(BUCKETS, dtype=np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        tf = np.zeros(len(index), dtype=np.int64)
        for where, n in parts:
            tf[where] += n
        none = lambda kind: pa.nulls(len(tf), kind)
        if len(tf):
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.string()), pa.array(tf), none(pa.int32()), none(pa.binary())], schema=SKETCH)
        index.clear()
        parts.clear()

    for batch in batches:
        for start, end in row_chunks(batch.column(0)):
            words, ids, row = split_tokens(batch.column(0).slice(start, end - start))
            names = words.to_pylist()
            where = np.array([index.setdefault(w, len(index)) for w in names], dtype=np.int64)
            parts.append((where, np.bincount(ids, minlength=len(names))))
            codes, same = word_codes(names)[ids], row[1:] == row[:-1]
            sums += np.bincount(pair_buckets(codes[:-1][same], codes[1:][same]), minlength=BUCKETS)
            if len(index) > WORDS or len(parts) > 200:
                yield from flush()
    yield from flush()
    for k, part in enumerate(np.split(sums, SLICES)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=SKETCH)


def frequent_buckets(least: int):
    """Rows (slice, sums), all of a slice in one task, to (slice, bits): which of its buckets reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(packed.as_buffer(), dtype=np.int64)
                total[k] = total[k] + part if k in total else part
        if total:
            bits = [np.packbits(v >= least).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])

    return run


def count_frequent(frequent: list[str], bits: dict[int, bytes]):
    """As ``count_terms`` for these tokens and the bigrams of two of them whose bucket is marked."""
    size = BUCKETS // SLICES
    marked = np.concatenate([np.unpackbits(np.frombuffer(bits[k], np.uint8)).astype(bool) if k in bits else np.zeros(size, bool) for k in range(SLICES)])
    codes = np.concatenate([np.zeros(1, np.uint64), word_codes(frequent)])
    index = {w: i + 1 for i, w in enumerate(frequent)}
    base = len(frequent) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            for start, end in row_chunks(batch.column(0)):
                n_rows = end - start
                words, ids, row = split_tokens(batch.column(0).slice(start, n_rows))
                w = np.array([index.get(x, 0) for x in words.to_pylist()], dtype=np.int64)[ids]
                pair = (row[1:] == row[:-1]) & (w[1:] > 0) & (w[:-1] > 0)
                first, second, at = w[:-1][pair], w[1:][pair], row[1:][pair]
                hit = marked[pair_buckets(codes[first], codes[second])]
                keys = np.concatenate([w[w > 0] * n_rows + row[w > 0], (first * base + second)[hit] * n_rows + at[hit]])
                keys.sort()
                each = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
                tf = np.diff(np.append(each, len(keys)))
                parts.append(_sums(keys[each] // n_rows, tf, np.ones(len(tf), np.int64)))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [_sums(*(np.concatenate(p) for p in zip(*parts)))]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield from rows(parts)
                        parts, held = [], 0
        yield from rows(parts)

    def rows(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if parts:
            code, tf, df = _sums(*(np.concatenate(p) for p in zip(*parts)))
            yield from _term_rows(pa.array(frequent, pa.string()), (code // base << 32) | code % base, tf, df)

    return run


class TermIndex:
    """Finds the terms of a vocabulary in texts; ``ids`` says what number each term stands for."""

    def __init__(self, terms: list[str], ids: list[int]):
        parts = [t.split(" ") for t in terms]
        self.index = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        base = len(self.index) + 1
        code = [0] * len(parts)
        for i, p in enumerate(parts):
            for w in p:
                code[i] = code[i] * base + self.index[w] + 1
        order = np.argsort(np.array(code, dtype=np.int64))
        self.codes, self.ids = np.array(code, dtype=np.int64)[order], np.array(ids, dtype=np.int64)[order]
        self.base = base

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, count) of each term in each text, sorted by row and id."""
        words, ids, row = split_tokens(texts)
        known = np.array([self.index.get(w, -1) for w in words.to_pylist()], dtype=np.int64) + 1
        w = known[ids] if len(ids) else ids
        paired = (row[1:] == row[:-1]) & (w[1:] > 0) & (w[:-1] > 0)
        code = np.concatenate([w[w > 0], (w[:-1] * self.base + w[1:])[paired]])
        where = np.concatenate([row[w > 0], row[1:][paired]])
        if not len(self.codes) or not len(code):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        width = int(self.ids.max()) + 1
        keys, count = np.unique(where[hit] * width + self.ids[at[hit]], return_counts=True)
        return keys // width, keys % width, count


def lists_by_row(n_rows: int, row: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    """One list a row of each of ``values``, which are sorted by ``row``."""
    offsets = pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in values]


def find_terms(index: TermIndex):
    """Batches (key, joined tokens) to rows (key, ids, counts) of the texts with a term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in row_chunks(batch.column(1)):
                part = batch.slice(start, end - start)
                row, ids, count = index.of(part.column(1))
                kept, at = np.unique(row, return_inverse=True)
                keys = part.column(0).take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([keys, *lists_by_row(len(kept), at, ids, count)], ["key", "ids", "counts"])

    return run


def weigh_keys(terms: pa.Array, idf: np.ndarray):
    """Rows (key, ids, counts), equal keys together, to rows (key, term, term_index, weight) of length 1 per key."""

    def weighed(keys: pa.Array, group: np.ndarray, ids: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = count * idf[ids]
        norm = np.sqrt(np.bincount(group, weights=w * w, minlength=len(keys)))
        arrays = [keys.take(pa.array(group)), terms.take(pa.array(ids)), pa.array(ids.astype(np.int32)), pa.array(w / norm[group])]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "term", "term_index", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, lists, counts = batch.columns
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            ids, count = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (lists, counts))
            if held is not None:
                keys = pa.concat_arrays([held[0], keys])
                row = np.concatenate([np.zeros(len(held[1]), np.int64), row + 1])
                ids, count = np.concatenate([held[1], ids]), np.concatenate([held[2], count])
            coded = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], coded[1:] != coded[:-1]])
            keys, group = keys.take(pa.array(np.flatnonzero(first))), (np.cumsum(first) - 1)[row]
            code, count = _sums(group * len(idf) + ids, count)
            group, ids = np.divmod(code, len(idf))
            end = int(np.searchsorted(group, len(keys) - 1))
            held = keys.slice(len(keys) - 1), ids[end:], count[end:]
            if end:
                yield from weighed(keys, group[:end], ids[:end], count[:end])
        if held is not None:
            yield from weighed(held[0], np.zeros(len(held[1]), np.int64), held[1], held[2])

    return run
