"""Weighted word shingles of texts as sorted arrays of 48-bit hashes with counts."""

from __future__ import annotations

import numpy as np

WIDTH = 5
MAX_TEXTS = 60_000  # texts a step: the text's number takes the upper 16 bits of a sort key

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE, _BASE5 = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, dtype=_U))


_POW = _powers(_BASE, 256)


def word_hashes(texts: list[str], ascii_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the hash of every lower-cased word between ASCII white space, text by text.

    ``ascii_case``: lower-case A-Z only.
    """
    if ascii_case:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    else:
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"".join([r + b"\n" for r in raw]), dtype=np.uint8)
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))
    if not len(buf):
        return np.empty(0, _U), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[buf]
    letter = ~space
    first = letter.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.empty(0, _U), bounds
    at = np.flatnonzero(letter)
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    rank = np.searchsorted(at, starts)
    values = (buf[at].astype(_U) + _U(1)) * _POW[place & 255]
    if place.max() > 255:  # long words go on in blocks with a factor of their own
        block = (place >> 8).astype(_U)
        values *= np.where(block > 0, mix64(block + _U(1)) | _U(1), _U(1))  # the first block none: a word's hash is its own alone
    return mix64(np.add.reduceat(values, rank)), bounds


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, counts, bounds): text i's distinct shingles, sorted, with how often each occurs.

    A text of fewer words than ``width``, but one at least, has one shingle of all its words.
    """
    assert len(texts) <= MAX_TEXTS
    h, bounds = word_hashes(texts)
    n = np.diff(bounds)
    powers = _powers(_BASE5, width)
    text = np.repeat(np.arange(len(texts)), n)
    m = len(h) - width + 1
    if m > 0:
        s = np.zeros(m, dtype=_U)
        for k in range(width):
            s += h[k : k + m] * powers[k]
        inside = np.arange(m) + width <= bounds[1:][text[:m]]
        s, owner = mix64(s[inside]), text[:m][inside]
    else:
        s, owner = np.empty(0, _U), np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        one = np.array([(h[bounds[d] : bounds[d + 1]] * powers[: n[d]]).sum(dtype=_U) + _U(int(n[d])) for d in short], dtype=_U)
        s, owner = np.concatenate([s, mix64(one)]), np.concatenate([owner, short])
    keys, counts = np.unique((owner.astype(_U) << _U(48)) | (s >> _U(16)), return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=_U) << _U(48))
    return keys & _U((1 << 48) - 1), counts, cuts


MOST = 65_535  # what the 16 bits of a count hold


def pack(elements: np.ndarray, counts: np.ndarray) -> bytes:
    """Element and count in one 64-bit word.

    A larger count than 16 bits hold is dealt to further elements, made from the first, of ``MOST`` each and the rest:
    lesser and greater counts of two texts then add up to those of the whole element.
    """
    if len(counts) and counts.max() > MOST:
        parts = [(elements, np.minimum(counts, MOST))]
        step, more = 0, elements
        while len(more):
            step += 1
            above = counts > MOST * step
            more, rest = elements[above], counts[above] - MOST * step
            parts.append((mix64(more + _U(step * int(_BASE) % 2**64)) >> _U(16), np.minimum(rest, MOST)))
        elements, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(elements, kind="stable")
        elements, counts = elements[order], counts[order]
    return ((elements << _U(16)) | counts.astype(_U)).tobytes()


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Sum of the lesser counts over the sum of the greater, of two packed shingle sets."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    low = _U(0xFFFF)
    total = int((x & low).sum()) + int((y & low).sum())
    if not total:
        return 0.0
    ex, ey = x >> _U(16), y >> _U(16)
    if len(ex) > len(ey):
        ex, ey, x, y = ey, ex, y, x
    at = np.minimum(np.searchsorted(ey, ex), max(len(ey) - 1, 0))
    same = ey[at] == ex if len(ey) else np.zeros(0, bool)
    both = int(np.minimum(x[same] & low, y[at[same]] & low).sum())
    return both / (total - both)
