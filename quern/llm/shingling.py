"""Word shingles of many texts at once: 64-bit hashes by NumPy over the bytes of an Arrow slice."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEPS = np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 64, WIDTH + 1, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, _BACK)]
    return _powers[0][:n], _powers[1][:n]


def word_spans(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts that end at `ends` begin and end. Words are runs of bytes other than space and
    U+0009 to U+000D."""
    n = len(body)
    gap = _GAP[body]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    cuts = ends[(ends > 0) & (ends < n)]
    before[cuts], after[cuts - 1] = True, True
    return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1


def span_hashes(body: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    powers, back = _power(len(body))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_BYTES[body] * powers, out=sums[1:])
    return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, A-Z lower-cased, and where each text ends in them."""
    return _LOWER[data[offsets[0] : offsets[-1]]], offsets[1:] - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z lower-cased, and the text it is in."""
    body, ends = lowered(data, offsets)
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, last = word_spans(body, ends)
    return span_hashes(body, first, last), np.searchsorted(ends, first, side="right")


def runs(hashes: np.ndarray, at: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of WIDTH words, repeats and all, and the text it is in. A text of fewer words has the whole
    sequence as its one run, and a text without words has none."""
    count = np.bincount(at, minlength=texts)
    parts, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(hashes) >= WIDTH:
        whole = len(hashes) - WIDTH + 1
        inside = np.flatnonzero(at[:whole] == at[WIDTH - 1 :])
        sums = np.full(len(inside), _STEPS[WIDTH])
        for k in range(WIDTH):
            sums += hashes[inside + k] * _STEPS[k]
        parts.append(mix(sums))
        where.append(at[inside])
    begin = np.cumsum(count) - count
    for size in range(1, WIDTH):
        short = np.flatnonzero(count == size)
        if len(short):
            sums = np.full(len(short), np.uint64(size))
            for k in range(size):
                sums += hashes[begin[short] + k] * _STEPS[k]
            parts.append(mix(sums))
            where.append(short)
    return np.concatenate(parts), np.concatenate(where)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its distinct shingles (see `runs`): (hash, text index), ordered by text and hash, and their number by text."""
    texts = len(offsets) - 1
    h, d = runs(*words(data, offsets), texts)
    if not len(h):
        return h, d, np.zeros(texts, np.int64)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, d, np.bincount(d, minlength=texts)


def sketches(h: np.ndarray, d: np.ndarray, texts: int, buckets: int) -> np.ndarray:
    """One-permutation MinHash: for each text and bucket 16 bits of the smallest hash there, 0 where there is none."""
    bits = buckets.bit_length() - 1
    least = np.full(texts * buckets, np.iinfo(np.uint64).max)
    np.minimum.at(least, d * buckets + (h >> np.uint64(64 - bits)).astype(np.int64), h)
    return np.where(least == np.iinfo(np.uint64).max, 0, (least & np.uint64(0xFFFF)) | np.uint64(1)).astype(np.uint16).reshape(texts, buckets)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimates of the Jaccard similarity of rows of sketches; 1 where both are empty."""
    some = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(some == 0, 1.0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(some, 1))


def sums_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums, modulo 2**64, of consecutive runs of the given sizes."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def set_keys(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set of shingles, in two numbers; equal sets have equal ones."""
    return sums_by(mix(h), sizes) + sizes.astype(np.uint64), sums_by(mix(h ^ np.uint64(0x5DEECE66D1234567)), sizes)


def set_id(k1: np.ndarray, k2: np.ndarray, seed: int) -> np.ndarray:
    return mix(k1 ^ mix(k2 + np.uint64(seed))).view(np.int64)


def parities(h: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each set a bit for each of 256 buckets, in four numbers: whether an odd number of its shingles is in it."""
    ends, out = np.cumsum(sizes), []
    bit, word = np.uint64(1) << (h & np.uint64(63)), h >> np.uint64(6) & np.uint64(3)
    for k in range(4):
        total = np.zeros(len(h) + 1, np.uint64)
        np.bitwise_xor.accumulate(np.where(word == np.uint64(k), bit, np.uint64(0)), out=total[1:])
        out.append(total[ends] ^ total[ends - sizes])
    return out
