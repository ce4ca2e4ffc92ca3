"""Vectorised hashes over bytes: of words, of word shingles, and polynomial ones of q-grams."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: Words of at most this many bytes are hashed by vector operations.
SHORT = 32
#: Positions that the polynomial prefix sums reach.
SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: Keeps the first 0 to 8 bytes of a little-endian value.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of the base and their inverses, for SEGMENT positions."""
    values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.ones(SEGMENT + 1, np.uint64)
        powers[1:] = _BASE
        powers = np.multiply.accumulate(powers)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        inverses = np.ones(SEGMENT + 1, np.uint64)
        inverses[1:] = inverse
        inverses = np.multiply.accumulate(inverses)
    return values, powers, inverses


def prefix(data: np.ndarray) -> np.ndarray:
    """s with s[i] = sum of value(data[j]) * base**j for j < i, at most SEGMENT bytes. Modulo 2**64: good to choose among
    q-grams and to bucket them, never to tell strings apart."""
    table, powers, _ = tables()
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * powers[: len(data)], out=out[1:])
    return out


def lanes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = SHORT):
    """For k = 0, 1, ...: places of the runs longer than 8 * k bytes and those runs' next 8 bytes as one value, zeros after
    their end. Runs start at begin and have size bytes; only their first `most` bytes are looked at."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for k in range(0, most, 8):
        at = np.flatnonzero(size > k)
        if not len(at):
            return
        yield at, eights[begin[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each [begin, end): one to one for sizes up to 8, xxh3 for long ones."""
    size = end - begin
    with np.errstate(over="ignore"):
        out = size.astype(np.uint64) * _BASE
    for at, value in lanes(data, begin, size):
        out[at] = mix(out[at] ^ value)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return out


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of every run outside \\x20 and \\x09-\\x0D; A-Z count as a-z."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    return begin, run_hashes(_LOWER[data], begin, end)


def separated(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts with a newline after each, so that no word spans two of them."""
    out = np.full(len(data) + len(offsets) - 1, 10, np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[a + i : b + i] = data[a:b]
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each text its sorted distinct k-word shingle hashes; fewer words make one shingle, none an empty set."""
    n = len(offsets) - 1
    joined = separated(data, offsets)
    start, word = word_hashes(joined)
    first = np.searchsorted(start, offsets + np.arange(n + 1))
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for j in range(k):
            run = (run ^ word[j : j + len(run)]) * np.uint64(0xD6E8FEB86659FD93)
            run ^= run >> np.uint64(29)
        run = mix(run)
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield np.unique(run[a : b - k + 1])
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                with np.errstate(over="ignore"):
                    h = mix(np.array([h * np.uint64(0x2545F4914F6CDD1D) + w], np.uint64))[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
