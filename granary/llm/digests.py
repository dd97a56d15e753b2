"""Document fingerprints: digests of improbable features in chained Bloom filters, compared by the bits they share.

A feature is a window of bytes. Windows are ranked by the rarity of their entropy: ``fit`` counts over all texts how many windows have each
(quantised) entropy, and the fewer share it, the more improbable is a window. In every run of consecutive windows the most improbable
one (the leftmost of equals) gains a point, and windows with enough points are a text's features. Windows of nearly no entropy
(rules, padding) are features only of texts that have no others. Texts too short for a choice also give all their small windows, and a text shorter
than those is one feature. Distinct features go, in the order of the text, into a Bloom filter until it is full, then into the next of the chain.

Likeness of two digests: each filter of the shorter chain is held against all of the other; the bits that two filters share, less those shared by
chance, are divided by the most they could share; the best counts, weighed by the features of the filter (chains of one length are held against each other both ways). So a text that is part of
another is like it, and texts that share no feature come out near 0.

Entropies are sliding sums over whole blocks of texts (a byte that enters or leaves a window changes the sum by what its number in
the window says), so no window is looked at on its own.

The edited copies of ``op11`` need each document's next one by descending doc_id. Documents are dealt once, into ranges of doc_id from approximate
quantiles, and sorted where they lie; of each range the first document goes to the range before it as well. So neighbours meet without
a window over one task, and texts are shuffled once.

Defined results: null is the empty text, which has no features and an empty fingerprint. Equal fingerprints have likeness 1, an empty and another one 0.
Rows of one doc_id follow each other by a hash of their text, repeated rows are like any others. Rows without a doc_id have a
fingerprint, but neither edited copy nor next document (null). Of a single document the next is itself. An empty table gives an empty
result. Further columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import BLOCK_BYTES, U64, _BASE, _INVERSE, mix, powers, salted

LEVELS = 1001  # entropies from 0 to 1 in thousandths
_VALUE = salted(256, 78)
_WEAK, _NONE = 1 << 20, 1 << 21  # ranks of windows that are used at need, and of places where no window begins
_SCALE = 1 << 12


@dataclass(frozen=True)
class Params:
    """``window`` bytes make a feature; of ``run`` consecutive ones (a power of 2) the rarest gains a point, and ``points`` make a feature. A text under ``short`` bytes
    gives all its windows of ``small`` bytes too. A filter has ``bits`` (a power of 2), ``hashes`` a feature and room for ``room`` features."""

    window: int = 16
    run: int = 64
    points: int = 8
    least_entropy: int = 100
    short: int = 160
    small: int = 6
    bits: int = 2048
    hashes: int = 5
    room: int = 160


def laid_out(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the texts one after the other, each followed by ``gap`` zero bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size + gap) - gap
    return np.frombuffer((bytes(gap)).join(texts) + bytes(gap), np.uint8), ends - size, ends


def _marked(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True at first[i]..end[i]-1 of each i."""
    edge = np.zeros(n + 1, np.int8)
    some = end > first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, end[some], -1)
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def entropies(data: np.ndarray, w: int) -> np.ndarray:
    """Level of the entropy of each window of w bytes, by the first byte's place."""
    k = np.arange(1, w + 1)
    step = np.diff(np.append(0, np.round(k * np.log2(k) * _SCALE))).astype(np.int32)  # what the k+1st of a byte adds to the sum of n log n
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, w):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    if len(data) < w:
        return np.zeros(0, np.int64)
    sums = np.cumsum(step[before], dtype=np.int64)[w - 1 :]
    sums[1:] -= np.cumsum(step[after], dtype=np.int64)[: len(sums) - 1]
    top = np.log2(w)
    return np.clip(((top - sums / (_SCALE * w)) * ((LEVELS - 1) / top) + 1e-6).astype(np.int64), 0, LEVELS - 1)


def level_counts(texts: list[bytes], p: Params) -> np.ndarray:
    data, starts, ends = laid_out(texts, p.window)
    return np.bincount(entropies(data, p.window)[_marked(len(data), starts, ends - p.window + 1)[: len(data) - p.window + 1]], minlength=LEVELS)


def features(texts: list[bytes], rank: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct features of all texts, by text and then in the order of the text."""
    w, run = p.window, p.run
    data, starts, ends = laid_out(texts, max(run, w))
    n, windows = len(data) - w + 1, ends - starts - w + 1
    level = entropies(data, w)
    order = np.where(level < p.least_entropy, _WEAK, rank[level])
    order[~_marked(n, starts, ends - w + 1)] = _NONE
    best = (order << 32) | np.arange(n)
    span = 1
    while span < run:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    chosen = best[_marked(len(best), starts, np.where(windows > 0, starts + np.maximum(windows - run, 0) + 1, starts))] & 0xFFFFFFFF
    begin = np.flatnonzero(np.diff(chosen, prepend=-1))
    at, points = chosen[begin], np.diff(np.append(begin, len(chosen)))
    text = np.searchsorted(starts, at, "right") - 1
    good = (points >= np.minimum(p.points, np.maximum(windows[text] - run + 1, 1))) & (order[at] < _WEAK)
    lacks = np.ones(len(texts), bool)
    lacks[text[good]] = False
    good |= lacks[text]
    at, text = at[good], text[good]

    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUE[data] * powers(_BASE, len(data)), out=total[1:])
    back = powers(_INVERSE, len(data) + 1)
    hashed = lambda first, end, kind: mix((total[end] - total[first]) * back[first] + U64(kind))
    parts = [(text, at, hashed(at, at + w, 0))]
    short = _marked(len(data), starts, np.where(ends - starts < p.short, ends - p.small + 1, starts))
    at = np.flatnonzero(short)
    parts.append((np.searchsorted(starts, at, "right") - 1, at + len(data), hashed(at, at + p.small, 1)))
    tiny = np.flatnonzero((ends > starts) & (ends - starts < p.small))
    parts.append((tiny, starts[tiny], hashed(starts[tiny], ends[tiny], 2)))
    text, place, h = (np.concatenate([x[i] for x in parts]) for i in range(3))
    by_hash = np.lexsort((place, h, text))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (np.diff(text[by_hash]) != 0) | (h[by_hash][1:] != h[by_hash][:-1])
    kept = by_hash[fresh]
    kept = kept[np.lexsort((place[kept], text[kept]))]
    return text[kept], h[kept]


def filters(texts: list[bytes], rank: np.ndarray, p: Params) -> list[np.ndarray]:
    """The chain of every text: a row a filter, its number of features and then its bits."""
    text, h = features(texts, rank, p)
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    chains = -(-np.diff(starts) // p.room)
    first = np.append(0, np.cumsum(chains))
    row = first[text] + (np.arange(len(text)) - starts[text]) // p.room
    bits = np.zeros((first[-1], p.bits), bool)
    width = p.bits.bit_length() - 1
    for k in range(p.hashes):
        bits[row, ((h >> U64(width * k)) & U64(p.bits - 1)).astype(np.int64)] = True
    rows = np.column_stack([np.bincount(row, minlength=first[-1]).astype(np.uint8), np.packbits(bits, axis=1)])
    return np.split(rows, first[1:-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1, of two chains."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0 or a.shape == b.shape and np.array_equal(a, b):
        return float(len(a) == len(b))
    bits = (a.shape[1] - 1) * 8
    x, y = (np.ascontiguousarray(c[:, 1:]).view(U64) for c in (a, b))
    full_x, full_y = (np.bitwise_count(c).sum(axis=1, dtype=np.int64) for c in (x, y))
    best, back = np.zeros(len(a)), np.zeros(len(b))
    for i in range(len(a)):
        shared = np.bitwise_count(y & x[i]).sum(axis=1, dtype=np.int64)
        chance, most = full_x[i] * full_y / bits, np.minimum(full_x[i], full_y)
        each = (shared - chance) / np.maximum(most - chance, 1e-9)
        best[i] = each.max()
        np.maximum(back, each, out=back)
    found = np.average(best, weights=np.maximum(a[:, 0], 1))
    if len(a) == len(b):
        found = (found + np.average(back, weights=np.maximum(b[:, 0], 1))) / 2
    return float(np.clip(found, 0, 1))


def read(fingerprint: str, p: Params = Params()) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 1 + p.bits // 8)


def _batches(texts: Iterator[bytes], size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def fit(docs: DataFrame, p: Params = Params(), text: str = "text") -> np.ndarray:
    """Rank of every entropy level, the rarest first, over all windows of all texts. A task sends a row a level at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            for part in _batches(x.as_py() or b"" for x in b.column(0).cast(pa.binary())):
                total += level_counts(part, p)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["level", "n"])

    n = np.zeros(LEVELS, np.int64)
    for r in docs.select(text).mapInArrow(run, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect():
        n[r.level] = r.n
    rank = np.empty(LEVELS, np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(LEVELS)
    return rank


def fingerprints(docs: DataFrame, rank: np.ndarray, p: Params = Params(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row, without a shuffle."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [c.tobytes().hex() for part in _batches(x.as_py() or b"" for x in b.column(2).cast(pa.binary())) for c in filters(part, rank, p)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.string())], names=[doc, "n_chars", "fingerprint"])

    rows = docs.select(doc, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"), text)
    return rows.mapInArrow(run, f"`{doc}` {kind}, n_chars bigint, fingerprint string")


def compared(pairs: DataFrame, p: Params = Params(), left: str = "fingerprint", right: str = "other") -> DataFrame:
    """``pairs`` with their likeness, from two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def like(a, b):
        import pandas as pd

        return pd.Series([None if x is None or y is None else likeness(read(x, p), read(y, p)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.withColumn("likeness", like(left, right))


def _place(value: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are greater than the value, by halving."""
    steps = [1 << i for i in range(len(bounds).bit_length())][::-1]
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # one literal, whatever its length
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: at + F.when(F.try_element_at(listed, at + s) > value, s).otherwise(0))


def in_order(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(part, again, doc_id, text) of the rows with a doc_id, in partitions of descending doc_id; each part ends with rows
    that are ``again`` in it: those of the doc_id after its last one."""
    spark = docs.sparkSession
    rows = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("b")).first().b or []
    bounds = sorted(set(found), reverse=True)
    rows = rows.withColumn("part", _place(F.col("doc_id"), bounds) if bounds else F.lit(0))
    tops = {r.part: r.top for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # a row for each part
    full = sorted(tops)
    before = {part: full[i - 1] for i, part in enumerate(full)}  # of the first part it is the last
    listed = lambda of, kind: F.split(F.lit(",".join(str(of.get(i, -1)) for i in range(len(bounds) + 1))), ",").cast(f"array<{kind}>")
    top, prior = F.get(listed(tops, "bigint"), F.col("part")), F.get(listed(before, "int"), F.col("part"))
    own, again = F.struct(F.col("part"), F.lit(False).alias("again")), F.struct(prior.alias("part"), F.lit(True).alias("again"))
    copies = F.when(F.col("doc_id") == top, F.array(own, again)).otherwise(F.array(own))
    dealt = rows.select(F.inline(copies), "doc_id", "text").repartitionById(len(bounds) + 1, F.col("part"))
    return dealt.sortWithinPartitions("again", F.desc("doc_id"), F.xxhash64("text"))


def with_next(docs: DataFrame, rank: np.ndarray, p: Params = Params(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bool, int, str]]]:
        part, held = [], 0
        for b in batches:
            for again, i, t in zip(b.column(1), b.column(2), b.column(3).cast(pa.binary()), strict=True):
                t = t.as_py() or b""
                if part and held + len(t) > BLOCK_BYTES:
                    yield part
                    part, held = [], 0
                part.append((again.as_py(), i.as_py(), t.decode(errors="surrogateescape")))
                held += len(t)
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = lambda t: t.encode(errors="surrogateescape")
        last, chain, over = None, None, False
        for rows in groups(batches):
            own = filters([raw(t) for _, _, t in rows], rank, p)
            pairs = []  # (row, its chain, next text, next chain)
            for row, c in zip(rows, own, strict=True):
                if last is not None and not over:
                    pairs.append((last, chain, row[2], c))
                over = over or row[0]  # only the first of the rows that are here again is a next one
                last, chain = row, c
            edited = [t[: len(t) - len(t) // 3] + following[: len(t) // 3] for (_, _, t), _, following, _ in pairs]
            data = [raw(t) for t in edited]
            prints = filters(data, rank, p) if data else []
            columns = [
                [i for (_, i, _), _, _, _ in pairs], [len(t) for (_, _, t), _, _, _ in pairs], [hashlib.sha256(t).hexdigest() for t in data],
                [c.tobytes().hex() for _, c, _, _ in pairs], [c.tobytes().hex() for c in prints],
                [likeness(c, e) for (_, c, _, _), e in zip(pairs, prints, strict=True)], [likeness(c, f) for _, c, _, f in pairs],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)

    out = in_order(docs, doc, text).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    alone = fingerprints(docs.where(F.col(doc).isNull()), rank, p, doc, text)
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    alone = alone.select(F.col(doc).cast("bigint").alias("doc_id"), "n_chars", nothing("edited_sha256", "string"), "fingerprint", nothing("edited_fingerprint", "string"), nothing("near_edited", "double"), nothing("near_next", "double"))
    return out.unionByName(alone)


def op11_improbable_digest(documents: DataFrame) -> DataFrame:
    return with_next(documents, fit(documents))
