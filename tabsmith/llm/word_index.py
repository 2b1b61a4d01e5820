"""Words of a text shard as numbers, and a bidirectional FM-index over them with batched interval extension."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

# Fixed by the contract: [.,;:!?\x0A-\x0D] end a piece, space and tab separate words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
_END, _GAP = 10, 32
STEP = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    factors = np.empty((2, n), dtype=_U)
    factors[0], factors[1] = _BASE, pow(_BASE, -1, 1 << 64)
    factors[:, 0] = 1
    both = np.cumprod(factors, axis=1)
    return both[0], both[1]


def plain_bytes(text: str) -> bytes:
    """UTF-8 with A-Z in lower case, a line feed for every end of a piece and a space for a tab."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_PLAIN)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, last) of the words of plain bytes; last: no word of the same piece follows."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    letter = ((buf != _END) & (buf != _GAP)).astype(np.int8)
    edge = np.diff(letter, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = np.empty(len(starts), dtype=_U)
    cuts = np.searchsorted(starts, np.arange(0, len(buf) + STEP, STEP))
    for i, j in zip(cuts[:-1], cuts[1:]):
        if i < j:
            a, z = starts[i], ends[j - 1]
            power, inverse = _powers(max(2 * STEP, 1 << int(z - a).bit_length()))
            sums = np.zeros(z - a + 1, dtype=_U)
            np.cumsum(_BYTE[buf[a:z]] * power[: z - a], out=sums[1:])
            at = starts[i:j] - a
            hashes[i:j] = (sums[ends[i:j] - a] - sums[at]) * inverse[at]
    piece = np.searchsorted(np.flatnonzero(buf == _END), starts)
    return starts, ends, hashes, np.append(piece[1:] != piece[:-1], True)[: len(starts)]


def number_words(raw: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, counts, sequence): the distinct words, most frequent first, and the text as their numbers from 1, 0 after each piece."""
    starts, ends, hashes, last = word_spans(raw)
    codes, distinct = pd.factorize(hashes)
    counts = np.bincount(codes, minlength=len(distinct))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    first = np.empty(len(distinct), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    words = [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in first[order]]
    sequence = np.zeros(len(codes) + int(last.sum()), dtype=np.int32)
    sequence[np.arange(len(codes)) + np.cumsum(last) - last] = rank[codes]
    return words, counts[order], sequence


class _Half:
    """The Burrows-Wheeler transform of a sequence whose rotations are sorted by their first ``depth`` symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int, depth: int):
        n = len(sequence)
        rows = np.arange(n)
        for _ in range(depth):  # stable sorts by one symbol more to the left each time
            rows = rows - 1
            if n:
                rows[rows < 0] = n - 1
            rows = rows[np.argsort(sequence[rows], kind="stable")]
        self.bwt = sequence[rows - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        by_symbol = np.argsort(self.bwt, kind="stable")
        self.places = self.bwt[by_symbol].astype(np.int64) * (n + 1) + by_symbol
        self.n = n

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before the row."""
        return np.searchsorted(self.places, symbol.astype(np.int64) * (self.n + 1) + row) - self.first[symbol]


class WordIndex:
    """FM-indexes of a sequence and of its reverse; a phrase is an interval of rows in each.

    Symbol 0 separates; phrases never hold it.  Intervals are right for phrases of up to ``depth`` words.
    """

    def __init__(self, sequence: np.ndarray, symbols: int, depth: int):
        sequence = np.concatenate([sequence, [0]]).astype(np.min_scalar_type(max(symbols, 1)))
        self.depth, self.symbols = depth, symbols
        self.halves = (_Half(sequence, symbols, depth), _Half(sequence[::-1], symbols, depth))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases, low, counts) of the words that occur: one column a word, low the first row in either half."""
        first = self.halves[0].first
        counts = np.diff(first)
        there = np.flatnonzero(counts)
        there = there[there > 0]
        return there[:, None], np.stack([first[there]] * 2), counts[there]

    def extend(self, phrases: np.ndarray, low: np.ndarray, counts: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every phrase with each word that stands before it (or, ``right``, after it) anywhere in the sequence.

        The words before a phrase are the transform over its interval; C and rank give the new interval there, and
        the number of lesser words in it gives the shift in the other half.
        """
        near, far = (1, 0) if right else (0, 1)
        half = self.halves[near]
        total = int(counts.sum())
        owner = np.repeat(np.arange(len(counts)), counts)
        start = np.cumsum(counts) - counts
        word = half.bwt[np.arange(total) - np.repeat(start - low[near], counts)]
        keys, found = np.unique(owner * np.int64(self.symbols + 1) + word, return_counts=True)
        owner, word = keys // (self.symbols + 1), keys % (self.symbols + 1)
        before = np.cumsum(found) - found - start[owner]  # lesser words in the interval
        new = np.empty((2, len(keys)), dtype=np.int64)
        new[near] = half.first[word] + half.rank(word, low[near][owner])
        new[far] = low[far][owner] + before
        real = word > 0
        parts = [phrases[owner], word[:, None]] if right else [word[:, None], phrases[owner]]
        return np.concatenate(parts, axis=1)[real], new[:, real], found[real]
