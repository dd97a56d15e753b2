"""Byte-level BPE encoding and decoding by the ranks of a published vocabulary file.

A pre-token is a linked list of byte spans. Every rank owns a bucket of list positions, and a two-level bitmap marks
the buckets that hold any: find-first-set on it gives the next rank, whose bucket is emptied from left to right.
Entries whose pair has changed since are stale and skipped. No step searches the list, so a pre-token of
a megabyte takes time in proportion to its length.

The unknown pre-tokens of a block of texts go through one queue together. A worker keeps the ids of short
pre-tokens it has met, in two generations of about ``CACHE`` each.

Defined results: null and empty texts have no ids and decode to an empty text. Special tokens are ordinary text.
Repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import named, with_new

CACHE = 250_000
SHORT = 48  # characters; longer pre-tokens are encoded anew
BLOCK = 1 << 18


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap."""

    def __init__(self, ranks: int):
        self.bits = max(1, (ranks.bit_length() + 1) // 2)
        self.mask = (1 << self.bits) - 1
        self.top, self.low, self.buckets = 0, [0] * ((ranks >> self.bits) + 1), {}

    def push(self, rank: int, position: int) -> None:
        found = self.buckets.get(rank)
        if found is not None:
            found.append(position)
            return
        self.buckets[rank] = [position]
        high = rank >> self.bits
        if not self.low[high]:
            self.top |= 1 << high
        self.low[high] |= 1 << (rank & self.mask)

    def extend(self, rank: int, positions: list[int]) -> None:
        self.push(rank, positions[0])
        self.buckets[rank].extend(positions[1:])

    def pop(self) -> tuple[int, list[int]]:
        """The smallest rank in use and its positions."""
        high = (self.top & -self.top).bit_length() - 1
        word = self.low[high]
        bit = word & -word
        self.low[high] = word = word ^ bit
        if not word:
            self.top ^= 1 << high
        rank = high << self.bits | bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _concatenate(table: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of each id's entry one after another, end of each entry)."""
    n = begin[ids + 1] - begin[ids]
    end = np.cumsum(n)
    at = np.repeat(begin[ids] - (end - n), n)
    at += np.arange(len(at))
    return table[at], end


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()))
        two = np.full(1 << 16, -1, np.int64)
        for k, v in ranks.items():
            if len(k) == 2:
                two[k[0] * 256 + k[1]] = v
        self.two = two
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for k, v in ranks.items():
            by_id[v] = k
        self.vocabulary = self._table(by_id)
        self.decimals = self._table([b"%d " % i for i in range(size)])

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        begin = np.zeros(len(entries) + 1, np.int64)
        np.cumsum([len(x) for x in entries], out=begin[1:])
        return np.frombuffer(b"".join(entries), np.uint8), begin

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as the bytes of 32-bit integers.

        All pieces share one list and one queue; ``stop`` marks where one ends, and no pair crosses it.
        """
        data, rank, queue = b"".join(pieces), self.ranks.get, self.queue
        n, begin = len(data), np.cumsum([0, *map(len, pieces)])
        stop = bytearray(n + 1)
        for x in begin.tolist():
            stop[x] = 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        of = np.frombuffer(data, np.uint8).astype(np.int64)
        first = np.full(n, -1, np.int64)
        first[:-1] = self.two[of[:-1] * 256 + of[1:]]
        first[begin[1:] - 1] = -1
        pair = first.tolist()  # the rank of the span at i joined with the one after it, or -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        values, cut = np.unique(first[at], return_index=True)
        for r, positions in zip(values.tolist(), np.split(at, cut[1:]), strict=False):
            queue.extend(r, positions.tolist())
        while queue.top:
            r, positions = queue.pop()
            positions.sort()
            for k, i in enumerate(positions):
                if pair[i] != r:
                    continue  # stale
                j = after[i]
                end = after[j]
                after[i] = end
                pair[j] = pair[i] = -1
                least = r
                if not stop[end]:
                    before[end] = i
                    x = rank(data[i : after[end]])
                    if x is not None:
                        pair[i] = x
                        queue.push(x, i)
                        if x < least:
                            least = x
                if not stop[i]:
                    h = before[i]
                    x = rank(data[h:end])
                    if x is None:
                        pair[h] = -1
                    else:
                        pair[h] = x
                        queue.push(x, h)
                        if x < least:
                            least = x
                if least < r:  # an earlier rank came up: the rest waits
                    if positions[k + 1 :]:
                        queue.extend(r, positions[k + 1 :])
                    break
        out, i, ids = [], 0, []
        while i < n:
            j = after[i]
            ids.append(rank(data[i:j]))
            if stop[j]:
                out.append(array("I", ids).tobytes())
                ids = []
            i = j
        return out

    def learn(self, missing: set[str]) -> None:
        """Takes the ids of these pre-tokens into the cache."""
        rank, todo = self.ranks.get, []
        for text in missing:
            found = self.old.get(text)
            if found is None:
                whole = rank(text.encode())
                if whole is None:
                    todo.append(text)
                    continue
                found = array("I", (whole,)).tobytes()
            self.young[text] = found
        if todo:
            self.young.update(zip(todo, self.merge([x.encode() for x in todo]), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        pieces = [self.find(x) if x else [] for x in texts]
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        missing = set().union(*pieces) - self.young.keys()
        if missing:
            self.learn(missing)
        ids_of = self.young.__getitem__
        parts = [b"".join(map(ids_of, x)) for x in pieces]
        for x in missing:
            if len(x) > SHORT:
                del self.young[x]
        ends = np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), np.uint32).astype(np.int64), ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        return self._split(self.vocabulary, ids, ends, 0)

    def as_decimals(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's ids in decimals, joined by one space."""
        return self._split(self.decimals, ids, ends, 1)

    @staticmethod
    def _split(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray, drop: int) -> list[bytes]:
        data, end = _concatenate(*table, ids)
        data, stop = data.tobytes(), np.concatenate([[0], end])[ends].tolist()
        return [data[a : max(a, b - drop)] for a, b in zip([0, *stop[:-1]], stop, strict=True)]


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One encoder a worker, with its cache."""
    if (path, pattern) not in _loaded:
        _loaded.clear()
        _loaded[path, pattern] = Bpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Rows in runs of about BLOCK characters."""
    sizes, at = pc.fill_null(pc.utf8_length(column), 0).to_pylist(), 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size < BLOCK):
            size += sizes[end]
            end += 1
        yield at, column.slice(at, end - at).to_pylist()
        at = end


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", digests: bool = False, ids: bool = True) -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and ``ids``; with ``digests`` also SHA-256 (lowercase hex) of the decimal
    ids joined by spaces and of the bytes that the ids decode to. Clashing columns are replaced.

    The vocabulary file lies at ``path`` on every machine, as an installed package does.
    """
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * ids
    new += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests
    kept = [c for c in docs.columns if c not in (text, *(f.name for f in new))]
    source = docs.select(*map(named, kept), named(text).cast("string").alias(text))
    names = [f"c{i}" for i in range(len(kept) + len(new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for at, texts in _runs(batch.column(len(kept))):
                found, ends = bpe.encode(texts)
                begin = np.concatenate([[0], ends])
                columns = [pa.array(np.diff(begin))]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(found.astype(np.int32))))
                if digests:
                    for parts in (bpe.as_decimals(found, ends), bpe.decode(found, ends)):
                        columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in parts]))
                rest = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, *columns], names=names)

    return with_new(source, run, len(kept), new)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids; bytes that are not UTF-8 become U+FFFD. Null ids give an empty text."""
    kept = [c for c in encoded.columns if c != text]
    source, at = encoded.select(*map(named, kept)), kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            rows = [x or [] for x in batch.column(at).to_pylist()]
            ends = np.cumsum([len(x) for x in rows], dtype=np.int64)
            flat = np.array([i for x in rows for i in x], np.int64)
            texts = [x.decode("utf-8", "replace") for x in bpe.decode(flat, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, f"c{len(kept)}"])

    return with_new(source, run, len(kept), [T.StructField(text, T.StringType())])


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(docs: DataFrame) -> DataFrame:
    return encode(docs.select("doc_id", "text"), *public_vocabulary(), digests=True, ids=False)
