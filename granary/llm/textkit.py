"""Hashing of words and shingles for whole batches of texts, as numpy array passes inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: About this many bytes of text are hashed at a time; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept from call to call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES * 2), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= BLOCK_BYTES * 8:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def salted(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * _BASE + U64(salt))


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_BYTE = salted(256, 77)[_lower]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts) for runs of rows; every text is followed by one space byte and null is empty.

    Text i of a block is ``data[starts[i]:starts[i + 1] - 1]``.
    """
    rows = texts.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(rows), 0).to_pylist()
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size + sizes[end] < BLOCK_BYTES):
            size += sizes[end] + 1
            end += 1
        part = [b"" if x is None else x for x in rows.slice(at, end - at).to_pylist()]  # no more of the texts is held twice
        starts = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in part], out=starts[1:])
        yield at, np.frombuffer(b" ".join(part) + b" ", np.uint8), starts
        at = end


def words(data: np.ndarray, starts: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, or whatever bytes ``breaks`` marks, A-Z lower-cased), their first and
    end bytes, and for each text the index of its first word (one entry more than texts)."""
    inside = ~breaks[data]
    inside[starts[1:] - 1] = False
    edge = np.diff(inside.astype(np.int8), prepend=0)
    first = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    h = (total[end] - total[first]) * powers(_INVERSE, len(data) + 1)[first]
    return mix(h + (end - first).astype(U64) * U64(0xD6E8FEB86659FD93)), first, end, np.searchsorted(first, starts)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j, c in enumerate(salted(n, 1000 + n)):
        out += mix(hashes[j : j + m] + c) * (c | U64(1))
    return mix(out)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words the
    whole sequence is one shingle, and a text without words has none."""
    for _, data, starts in blocks(texts):
        h, _, _, at = words(data, starts)
        all_of = ngrams(h, n)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(all_of[a : b - n + 1])
            elif b > a:
                yield ngrams(h[a:b], b - a)
            else:
                yield np.zeros(0, U64)
