"""Repeated byte strings of at least ``least`` bytes, by common-prefix interval trees over sparse suffix arrays.

No task could hold the suffixes of a corpus, so suffixes are dealt by content. A string of ``least`` bytes is filed under
the least hash of its ``GRAM``-byte pieces (the last of equals), its anchor; equal strings have equal anchors. The strings
of a text that share an anchor are consecutive and make one *piece*. Anchors are shuffled as hashes only; those of a single text
are dropped; the pieces of the others meet, sorted by anchor and document.

A piece of an anchor that ``HOT`` texts share is filed twice, by more of its bytes: the strings that begin at least ``SIDE`` bytes before the
anchor by those bytes and the anchor, the others by the anchor and as many bytes behind it. Equal strings lie alike around their anchor, so they
still meet, and what meets has 33 bytes in common: a frequent anchor does not gather its contexts in one task.

There, suffixes of pieces whose first ``least`` bytes come but once are dropped, as are those that are all preceded by one byte
within their pieces (they continue a repeat that starts earlier). The rest are sorted into a suffix array with their common
prefix lengths. A scan with a stack yields the tree of intervals of suffixes with a common prefix of at least
``least`` bytes. An interval whose occurrences differ in the byte before them, or have none in their piece, cannot be extended:
it is a maximal repeat (within pieces) and is put out with all of its occurrences, at every depth of the tree. For removal, what the
repeats cover of a piece is merged there; ``maximal_repeats`` joins the repeats of neighbouring pieces that lie alike to their first occurrence.

Equal texts are one node, named by a hash; they are told from their first by a table of (text, smallest doc_id).
A piece that a task has already sent for a smaller document is sent as a mark without its bytes, so a passage in a third
of all documents makes a few rows a task. Arrays hold ``RUN`` bytes of suffixes at most; longer groups are read in runs, and pieces that brought anything new are carried on.

Defined results: null texts are empty; texts under ``least`` bytes repeat nothing. Rows with a null doc_id keep all their
bytes and are no one's first. Rows alike in doc_id are no repeats of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .textkit import U64, mix, powers, salted

GRAM = 16
BLOCK = 1 << 18
SIDE, HOT = 17, 500
RUN = 12_000_000  # bytes of the suffixes of one array
_B = U64(0x9E3779B97F4A7C15)
_BYTES = salted(256, 31)
_KNOWN = 200_000


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive entries, by doubling."""
    have = 1
    while have * 2 <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (w - have)], v[w - have :]) if w > have else v


def pieces_of(data: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(anchor, its place, first string's start, last string's start) of the pieces of one text. 48 bits tell anchors apart well
    enough up to a petabyte: an anchor that two different strings share costs a comparison, no more."""
    if len(data) < least:
        return np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3
    out = []
    for at in range(0, len(data) - least + 1, BLOCK):
        part = data[at : at + BLOCK + least - 1]
        h = _BYTES[part]
        n = 1
        while n < GRAM:  # hash of 2, 4, 8 and 16 bytes
            h = h[:-n] * U64(0xD6E8FEB86659FD93 + 2 * n) + (h[n:] ^ (h[n:] >> U64(29)))
            n *= 2
        h = mix(h)
        place = np.arange(len(h), dtype=U64)
        tagged = (h & ~U64(0xFFFFFF)) | (U64(0xFFFFFF) - place)  # the last of equals is the least
        anchor = (U64(0xFFFFFF) - (_sliding_least(tagged, least - GRAM + 1) & U64(0xFFFFFF))).astype(np.int64)
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        out.append((h[anchor[new]] >> U64(16), anchor[new] + at, new + at, np.r_[new[1:], len(anchor)] - 1 + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, size = [], [], 0
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if node in seen:
                    continue
                if len(seen) >= _KNOWN:
                    seen.clear()
                seen.add(node)
                k = np.unique(pieces_of(np.frombuffer(text, np.uint8), least)[0])
                keys.append(k.view(np.int64))
                nodes.append(np.full(len(k), node))
                size += len(k)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])
                    keys, nodes, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


#: Bits of an anchor; the one above marks those that ``HOT`` texts share.
_BITS = 48


def _shared(many: int):
    """Rows (key, node), sorted, whose key more than one node has, with the mark of the many. Fewer than ``many`` rows are held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k0, n0, hot0 = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # rows of the key that is open; once it is hot, the last one, put out already
        for batch in batches:
            if not len(batch):
                continue
            done = len(k0) if hot0 else 0
            k = np.concatenate([k0, batch.column("key").to_numpy()])
            n = np.concatenate([n0, batch.column("node").to_numpy()])
            keep = np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])]
            k, n = k[keep], n[keep]
            group = np.cumsum(np.r_[False, k[1:] != k[:-1]])
            count = np.bincount(group)
            if hot0 and k[0] == k0[0]:
                count[0] += many
            out = (count > 1)[group]
            out[:done] = False
            open_ = group == group[-1]
            hot0 = bool(count[-1] >= many)
            if not hot0:
                out &= ~open_
            yield pa.RecordBatch.from_arrays([pa.array(k[out] | (count >= many)[group[out]].astype(np.int64) << _BITS), pa.array(n[out])], names=["key", "node"])
            k0, n0 = (k[-1:], n[-1:]) if hot0 else (k[open_], n[open_])
        if not hot0 and len(k0) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(k0), pa.array(n0)], names=["key", "node"])

    return run


#: A place holds the start of a piece and, above, a part of the text's hash, for rows that share a doc_id.
_START = 40


def _halves(key: int, text: bytes, at: int, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """(key, first start, last start) of the strings that reach ``SIDE`` bytes to the left of the anchor at ``at``, and of the others."""
    if a <= at - SIDE:
        yield (key << 15) ^ (crc32(text[at - SIDE : at + GRAM]) << 1), a, min(b, at - SIDE)
    if b > at - SIDE:
        yield (key << 15) ^ (crc32(text[at : at + GRAM + SIDE]) << 1) ^ 1, max(a, at - SIDE + 1), b


def _cut(least: int, marks: bool):
    """Pieces with shared anchors: (key, doc_id, place, bytes, size); with ``marks`` bytes are null, and size is not, where they are known to come earlier."""
    if least - GRAM < 2 * SIDE:
        raise ValueError(f"strings of {GRAM + 2 * SIDE} bytes at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, tag, node, own, text, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "node", "first_node")), batch.column("text"), batch.column("keys"), strict=True):
                if node != own:
                    continue  # another text of this doc_id
                text = text.as_buffer().to_pybytes()
                found, at, first, last = pieces_of(np.frombuffer(text, np.uint8), least)
                keys = keys.values.to_numpy()
                keep = np.isin(found.view(np.int64), keys & ((1 << _BITS) - 1))
                hot = set((keys[keys >> _BITS > 0] & ((1 << _BITS) - 1)).tolist())
                tag <<= _START
                for anchor in zip(found[keep].view(np.int64).tolist(), *(x[keep].tolist() for x in (at, first, last)), strict=True):
                    for key, a, b in _halves(anchor[0], text, *anchor[1:]) if anchor[0] in hot else [(anchor[0] << 15, *anchor[2:])]:
                        part = text[a : b + least]
                        if marks:
                            if len(known) >= _KNOWN:
                                known.clear()
                            old = known.get(part)
                            if old is not None and old < doc:
                                rows.append((tag + doc % 1024, doc, tag | a, None, b + least - a))
                                continue
                            known[part] = doc
                        rows.append((key, doc, tag | a, part, None))
                if len(rows) > 20_000:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)

    return run


_PIECE = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary()), ("size", pa.int32())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)


def maximal(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(group, piece, offset, length, first piece, its offset) of every occurrence of every maximal repeat of these pieces, which
    come in the order of documents and places within a key."""
    size = np.array([len(x) for x in texts])
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts) + bytes(96), np.uint8)
    count = size - least + 1
    piece = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[piece] + offset
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * powers(_B, len(data)), out=total[1:])
    back = powers(U64(pow(int(_B), -1, 1 << 64)), len(data))
    print_ = mix((total[at + least] - total[at]) * back[at])
    order = np.argsort(print_, kind="stable")
    same = print_[order][1:] == print_[order][:-1]
    group = np.cumsum(np.r_[True, ~same]) - 1
    many = np.bincount(group) > 1
    # a group goes on from the left if all of it has the same byte before it, within its pieces
    left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 300)[order]
    heads = np.flatnonzero(np.r_[True, ~same])
    diverse = (np.maximum.reduceat(left, heads) != np.minimum.reduceat(left, heads)) | (np.maximum.reduceat(left, heads) == 300)
    pick = order[(many & diverse)[group]]
    if not len(pick):
        return (np.zeros(0, np.int64),) * 6
    piece, offset, at = piece[pick], offset[pick], at[pick]
    room = size[piece] - offset
    wide = 8 * (-(-int(room.max()) // 8))
    data = np.concatenate([data, np.zeros(wide, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(data, wide)[at]
    rows[np.arange(wide)[None, :] >= room[:, None]] = 0
    words = np.ascontiguousarray(rows).view(">u8").astype(U64)
    sa = np.lexsort(words.T[::-1])
    rows, room, piece, offset = rows[sa], room[sa], piece[sa], offset[sa]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    lcp = np.minimum(np.minimum(lcp, room[1:]), room[:-1])
    prev = np.where(offset > 0, data[np.maximum(begin[piece] + offset - 1, 0)].astype(np.int64), 256 + piece)
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix) of open intervals
    for i, length in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > length:
            deep, first = stack.pop()
            out.append((deep, first, i))
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    if not out:
        return (np.zeros(0, np.int64),) * 6
    deep, lo, hi = (np.array(x) for x in zip(*out, strict=True))
    change = np.r_[0, np.cumsum(prev[1:] != prev[:-1])]
    good = change[hi] > change[lo]  # left extension differs somewhere between lo and hi
    deep, lo, hi = deep[good], lo[good], hi[good]
    n = hi - lo + 1
    group = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n) + lo[group]
    lead = np.minimum.reduceat(piece[i] << 16 | offset[i], np.cumsum(n) - n)[group] if len(n) else piece[i]
    return group, piece[i], offset[i], deep[group], lead >> 16, lead & 0xFFFF


def covered(piece: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, length) of the stretches of pieces that these stretches cover together."""
    if not len(piece):
        return piece, offset, length
    start = piece << 20 | offset
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate((start + length)[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    end = reach[np.r_[new[1:] - 1, len(reach) - 1]]
    return start[new] >> 20, start[new] & 0xFFFFF, end - start[new]


_SPAN = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("length", pa.int32())])
_OCCURRENCE = pa.schema([*_SPAN, ("first_doc", pa.int64()), ("first_place", pa.int64())])


def _trees(least: int, groups: bool):
    """From pieces in the order of key, doc_id and place: what is repeated of earlier documents (doc_id, place, length); with ``groups``
    all occurrences of maximal repeats but the first, each with that one (first_doc, first_place)."""

    def solve(rows: pa.RecordBatch, open_: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        texts = rows.column("bytes").to_pylist()
        doc, place = (rows.column(c).to_numpy() for c in ("doc_id", "place"))
        _, piece, offset, length, lead, lead_at = maximal(texts, least)
        later = doc[lead] < doc[piece]
        if groups:
            pick = (piece != lead) | (offset != lead_at)
            columns = (doc[piece], place[piece] + offset, length, doc[lead], place[lead] + lead_at)
            found = pa.RecordBatch.from_arrays([pa.array(c[pick], f.type) for c, f in zip(columns, _OCCURRENCE, strict=True)], schema=_OCCURRENCE)
        else:
            p, o, n = covered(piece[later], offset[later], length[later])
            found = pa.RecordBatch.from_arrays([pa.array(doc[p]), pa.array(place[p] + o), pa.array(n, pa.int32())], schema=_SPAN)
        if not open_:
            return found, None
        key = rows.column("key").to_numpy()
        hide = np.zeros(len(texts), bool)  # pieces all of whose bytes come earlier bring nothing new
        size = np.array([len(x) for x in texts])
        hide[piece[later & (offset == 0) & (length == size[piece])]] = True
        return found, rows.filter(pa.array((key == key[-1]) & ~hide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            marks = batch.filter(batch.column("bytes").is_null())
            if len(marks):
                yield pa.RecordBatch.from_arrays([marks.column("doc_id"), marks.column("place"), marks.column("size")], schema=_SPAN)
            batch = batch.filter(batch.column("bytes").is_valid())
            size = pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64)
            cost, at = np.cumsum(size * (size - least + 1)), 0
            while at < len(batch):
                base = int(cost[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(cost, base + max(RUN - held, RUN // 2), side="right")))  # what is carried on leaves room for as much again
                kept.append(batch.slice(at, end - at))
                held += int(cost[end - 1]) - base
                at = end
                if held >= RUN or at < len(batch):
                    found, rest = solve(pa.concat_batches(kept), True)
                    yield found
                    size = pc.binary_length(rest.column("bytes")).to_numpy().astype(np.int64)
                    kept, held = [rest], int((size * (size - least + 1)).sum())
        if sum(map(len, kept)):
            yield solve(pa.concat_batches(kept), False)[0]

    return run


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, node, tag, text): whole texts, null as empty, with the hash that names a text and a part of it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node = F.xxhash64(text, F.crc32(text.cast("binary")))
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("bigint").alias("doc_id")
    return docs.select(doc_id, node.alias("node"), _tag(node).alias("tag"), text.alias("text"))


def _tag(node: Column) -> Column:
    return node.bitwiseAND(F.lit((1 << 22) - 1))


def first_copies(texts: DataFrame) -> DataFrame:
    """(node, first): the smallest doc_id with each text."""
    return texts.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"))


def _pieces(texts: DataFrame, first: DataFrame, least: int, marks: bool) -> DataFrame:
    """Shared pieces, each key's together in order, from ``named`` texts that have a doc_id and their ``first_copies``."""
    some = texts.where(f"octet_length(text) >= {least}")
    anchors = some.select("node", "text").mapInArrow(_anchors(least), "key bigint, node bigint")
    shared = anchors.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared(HOT), "key bigint, node bigint")
    keys = written(shared.groupBy("node").agg(F.collect_list("key").alias("keys")))  # a list is bounded by the length of one text
    of_first = keys.join(first, "node").select(F.col("first").alias("doc_id"), _tag(F.col("node")).alias("tag"), F.col("node").alias("first_node"), "keys")
    # joined by (doc_id, tag) alone, as the spans are later, so that the shuffled texts serve both joins
    pieces = texts.join(of_first, ["doc_id", "tag"]).mapInArrow(_cut(least, marks), "key bigint, doc_id bigint, place bigint, bytes binary, size int")
    return pieces.repartition("key").sortWithinPartitions("key", "doc_id", "place")


def _placed(place: str, tag: str, start: str) -> list[Column]:
    return [F.shiftright(place, _START).alias(tag), F.col(place).bitwiseAND(F.lit((1 << _START) - 1)).alias(start)]


def maximal_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """(group, doc_id, tag, start, length): groups of equal stretches of at least ``least`` bytes, with their first occurrence and all others,
    over the first copies of all texts (tag tells texts of one doc_id apart).

    A repeat longer than a piece is put together from those of its pieces that lie alike to one first occurrence, so a stretch whose
    parts come first in several documents makes a group for each of these."""
    texts = named(docs).where("doc_id is not null")
    schema = "doc_id bigint, place bigint, length int, first_doc bigint, first_place bigint"
    found = _pieces(texts, written(first_copies(texts)), least, marks=False).mapInArrow(_trees(least, groups=True), schema)
    found = found.select("doc_id", *_placed("place", "tag", "start"), "length", "first_doc", *_placed("first_place", "first_tag", "first_start"))
    # along each line (document, first document, distance), which is no longer than a text, stretches that touch become one
    line = Window.partitionBy("doc_id", "tag", "first_doc", "first_tag", F.col("start") - F.col("first_start")).orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(line))
    spans = runs.groupBy("doc_id", "tag", "first_doc", "first_tag", (F.col("start") - F.col("first_start")).alias("by"), "run").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"))
    spans = spans.select("doc_id", "tag", "start", "first_doc", "first_tag", (F.col("start") - F.col("by")).alias("first_start"), "length")
    group = F.xxhash64("first_doc", "first_tag", "first_start", "length").alias("group")
    firsts = spans.select(group, F.col("first_doc").alias("doc_id"), F.col("first_tag").alias("tag"), F.col("first_start").alias("start"), "length")
    return spans.select(group, "doc_id", "tag", "start", "length").union(firsts).distinct()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans"), strict=True):
            n, lo, hi = len(text), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if spans.is_valid:
                a, size = (spans.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(a)
                a, reach = a[order], np.minimum(np.maximum.accumulate((a + size)[order]), n)
                new = np.r_[True, a[1:] > reach[:-1]]
                lo, hi = a[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]]
            cut = np.stack([np.r_[0, hi], np.r_[lo, n]], axis=1).tolist()
            rows.append((doc, n, int((hi - lo).sum()), len(lo), hashlib.sha256(b"".join(text[x:y] for x, y in cut)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """A row for each document: bytes, bytes and runs removed (those that also start in an earlier document), hash of the rest."""
    texts = named(docs).where("doc_id is not null")  # as it stands in both joins, so that Spark shuffles the texts once
    first = written(first_copies(texts))
    found = _pieces(texts, first, least, marks=True).mapInArrow(_trees(least, groups=False), "doc_id bigint, place bigint, length int")
    later = found.select("doc_id", *_placed("place", "tag", "start"), F.col("length").cast("bigint").alias("length"))
    copies = texts.where(f"octet_length(text) >= {least}").select("doc_id", "tag", "node").join(first, "node").where("first < doc_id")
    later = later.union(copies.select("doc_id", "tag", F.lit(0).cast("bigint"), F.lit(1 << _START).cast("bigint")))
    spans = later.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    rows = texts.join(spans, ["doc_id", "tag"], "left").select("doc_id", "node", "text", "spans")  # node: see above
    nameless = named(docs).where("doc_id is null").select("doc_id", "node", "text", F.lit(None).cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return rows.union(nameless).mapInArrow(_digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op4_suffix_array(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"))


#: Every 50-byte string by its hexadecimal digits, cut from blocks of a thousand bytes.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), l AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
k1 AS (SELECT doc_id, b, n, substr(x, 2000 * b + 1, 2098) AS y FROM (SELECT doc_id, x, n, unnest(range(0, (n + 999) // 1000)) AS b FROM l)),
s AS (SELECT doc_id, 1000 * b + q AS p, md5(substr(y, 2 * q + 1, 100)) AS h FROM (SELECT doc_id, b, y, unnest(range(0, least(1000, n - 49 - 1000 * b))) AS q FROM k1)),
f AS (SELECT h, min(doc_id) AS d0 FROM s GROUP BY h), later AS (SELECT doc_id, p FROM s JOIN f USING (h) WHERE d0 < doc_id),
new AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM new) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_ FROM runs),
k AS (SELECT g.doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, string_agg(substr(x, 2 * from_ + 1, 2 * (lo - from_)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM gaps g JOIN l ON l.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT l.doc_id, l.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM l LEFT JOIN k ON k.doc_id = l.doc_id
"""
