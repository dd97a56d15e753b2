"""Removal of repeated passages by sliding sentence spans.

A text is cut into sentences, and these into their parts: a piece ends with closing punctuation, a comma, semicolon or colon, or at a
line end, and takes the white space after it. From each piece starts one span: the shortest run of at least two pieces that has
``least`` words; longer repeats are covered by the spans in them, but for a rest of fewer words. The last span is taken once more up to
the end of the text, so that whole copies go whole. A text that holds no span is one itself. Spans are hashed, letter
case and spacing aside, and joined over all documents: of equal spans the one of the smallest doc_id, and in it the
first, stays; the pieces of all others go.

Parts of sentences, not whole ones, because a passage copied from the middle of a sentence to the middle of another
shares few whole ones; a number of words, not of sentences, because runs of very short ones come up by chance.

Within a document, spans that come again are marked by sorting its own array. Only each document's distinct spans are
shuffled: once as a grouped minimum, combined before the shuffle, and once for the join with the spans that
more than one document has. No group of equal spans is ever brought together.

Defined results: null texts stay null, empty and blank ones are kept. Rows with a null doc_id are kept and are no one's
first. Rows with one doc_id count as one document and are treated by their own texts. All columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import let, named, unused, written
from .textkit import _BASE, _INVERSE, U64, blocks, mix, powers, salted

LEAST = 20
_ENDS = r".!?,;:\n"


def pieces(text: Column) -> Column:
    """The pieces of a text; joined together they are the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(rf"([^{_ENDS}]*+[{_ENDS}]*+\s*+)"), F.lit(1)), lambda x: x != "")


_WHITE, _PURE = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_PURE[[ord(c) for c in ".!?,;:"]] = True
_BYTE = salted(256, 79)


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First byte of every piece of texts that follow each other, each with a space behind it; as ``pieces`` has them."""
    i = np.arange(len(data))
    white, newline = _WHITE[data], data == 10
    begin = np.repeat(starts[:-1], np.diff(starts))  # of each byte its text
    before = lambda mark: np.r_[-1, np.maximum.accumulate(np.where(mark, i, -1))[:-1]]  # noqa: E731  the last such byte before each
    other, space, line = before(~white), before(white & ~newline), before(newline)
    inside = other >= begin  # else nothing but white space stands before it in its text
    closed = inside & _PURE[data[np.maximum(other, 0)]]
    other = np.where(inside, other, begin - 1)
    coming = np.r_[np.minimum.accumulate(np.where(newline, i, len(data))[::-1])[::-1], len(data)]  # the first newline from each byte on
    # punctuation and the newlines after it end a piece, which takes the white space behind; more punctuation after that white space is a piece of its own
    new = np.where(_PURE[data], np.where(closed, space > other, coming[other + 1] < space), closed | (line > other)) & ~white
    new[starts[:-1]] = True
    return np.flatnonzero(new)


def spans_of(data: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, hash, first piece, last piece) of the span from each piece, and of the rests, of lower-cased texts that are not blank."""
    first = piece_starts(data, starts)
    at = np.searchsorted(first, starts)  # of each text its first piece
    solid = np.flatnonzero(~_WHITE[data])
    piece = np.searchsorted(first, solid, "right") - 1
    gap = np.zeros(len(solid), np.int64)  # white space between words of a piece is one space, and one stands between pieces
    gap[1:] = (np.diff(solid) > 1) & (np.diff(piece) == 0)
    plain = np.full(len(solid) + int(gap.sum()) + len(first), 0x20, np.uint8)
    plain[np.arange(len(solid)) + np.cumsum(gap) + piece] = data[solid]
    gaps = np.bincount(piece, gap, len(first)).astype(np.int64)
    begin = np.append(0, np.cumsum(np.bincount(piece, minlength=len(first)) + gaps + 1))
    words = np.append(0, np.cumsum(gaps + 1))

    lo = np.arange(len(first))
    last = np.repeat(at[1:] - 1, np.diff(at))
    hi = np.maximum(np.searchsorted(words, words[:-1] + least) - 1, lo + 1)
    good = hi <= last
    final = np.zeros(len(at) - 1, np.int64)  # the last piece from which a span starts, if any
    np.maximum.at(final, np.searchsorted(at, lo[good], "right") - 1, lo[good])
    has = np.zeros(len(at) - 1, bool)
    has[np.searchsorted(at, lo[good], "right") - 1] = True
    rest = np.where(has, final, at[:-1])
    more = ~has | (hi[np.minimum(rest, len(hi) - 1)] < at[1:] - 1)
    lo, hi = np.concatenate([lo[good], rest[more]]), np.concatenate([hi[good], (at[1:] - 1)[more]])

    total = np.zeros(len(plain) + 1, U64)
    np.cumsum(_BYTE[plain] * powers(_BASE, len(plain)), out=total[1:])
    a, e = begin[lo], begin[hi + 1] - 1
    h = mix((total[e] - total[a]) * powers(_INVERSE, len(plain) + 1)[a] + (e - a).astype(U64) * U64(0xD6E8FEB86659FD93))
    text = np.searchsorted(at, lo, "right") - 1
    return text, h.view(np.int64), lo - at[text], hi - at[text]


_SPANS = "array<struct<h:bigint,lo:int,hi:int>>"


def _spans(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, version, first, again): distinct spans of a document at their first place, and those at other places."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lower = pa.array([t.decode(errors="surrogateescape").lower().encode(errors="surrogateescape") for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())
            for row, data, starts in blocks(lower):
                text, h, lo, hi = spans_of(data, starts, least)
                order = np.lexsort((lo, h, text))
                text, h, lo, hi = text[order], h[order], lo[order], hi[order]
                fresh = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])][: len(h)]
                lists = []
                for some in (fresh, ~fresh):
                    struct = pa.StructArray.from_arrays([pa.array(h[some]), pa.array(lo[some], pa.int32()), pa.array(hi[some], pa.int32())], names=["h", "lo", "hi"])
                    lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[some], np.arange(len(starts))), pa.int32()), struct))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(row, len(starts) - 1) for k in (0, 1)), *lists], names=["doc_id", "version", "first", "again"])

    text = F.col("text").cast("string")
    some = docs.where(F.col("doc_id").isNotNull() & text.rlike(r"\S")).select("doc_id", F.xxhash64(text).alias("version"), text.alias("text"))
    return written(some.mapInArrow(run, f"doc_id {kind}, version bigint, first {_SPANS}, again {_SPANS}"))


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, version, spans): (lo, hi) pieces of the spans that are not the first of their kind."""
    cut = _spans(docs, least)
    flat = cut.select("doc_id", "version", F.explode("first").alias("r")).select("doc_id", "version", "r.h", "r.lo", "r.hi")
    shared = flat.groupBy("h").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("h", "d0")
    later = flat.join(shared, "h").where("doc_id > d0").select("doc_id", "version", "lo", "hi")
    inside = cut.where(F.size("again") > 0).select("doc_id", "version", F.explode("again").alias("r")).select("doc_id", "version", "r.lo", "r.hi")
    return later.union(inside).groupBy("doc_id", "version").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def dedup_sentences(docs: DataFrame, least: int = LEAST, counts: bool = False) -> DataFrame:
    """``docs`` without repeated spans; with ``counts`` also ``n_pieces`` and ``n_removed``."""
    d, v, x = (unused(docs, c) for c in ("d", "v", "x"))
    found = repeated_spans(docs, least).select(F.col("doc_id").alias(d), F.col("version").alias(v), F.col("spans").alias(x))
    text = F.col("text").cast("string")
    joined = docs.join(found, (F.col("doc_id") == F.col(d)) & (F.xxhash64(text) == F.col(v)), "left")

    def cleaned(parts: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(x, lambda r: F.sequence(r["lo"], r["hi"]))))
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        kept = F.when(F.col(x).isNull(), text).otherwise(F.array_join(F.transform(left, lambda j: F.get(parts, j)), ""))
        return F.struct(kept.alias("text"), F.size(parts).cast("bigint").alias("n"), F.when(F.col(x).isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias("gone"))

    out = joined.withColumn(x, let(pieces(F.coalesce(text, F.lit(""))), cleaned))
    extra = [F.col(x)["n"].alias("n_pieces"), F.col(x)["gone"].alias("n_removed")] if counts else []
    kept = F.when(text.isNotNull(), F.col(x)["text"])
    return out.select(*(kept.alias(c) if c == "text" else named(c) for c in docs.columns if not (counts and c in ("n_pieces", "n_removed"))), *extra)


def op10_sentence_spans(docs: DataFrame) -> DataFrame:
    return dedup_sentences(docs.select("doc_id", "text"), counts=True).select("doc_id", "n_pieces", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?,;:\n]*[.!?,;:\n]+\s*|[^.!?,;:\n]+') AS pieces FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, generate_subscripts(pieces, 1) - 1 AS i, unnest(pieces) AS x FROM s),
c AS (SELECT doc_id, i, x, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS y FROM p),
w AS (SELECT doc_id, i, y, length(y) - length(replace(y, ' ', '')) + 1 AS n, sum(length(y) - length(replace(y, ' ', '')) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM c),
e AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 19 AND b.upto - a.upto + a.n >= 20 GROUP BY a.doc_id, a.i),
t AS (SELECT doc_id, max(i) AS last FROM c GROUP BY doc_id),
r AS (SELECT doc_id, i, j FROM e UNION SELECT e.doc_id, max(i), last FROM e JOIN t ON t.doc_id = e.doc_id GROUP BY e.doc_id, last UNION ALL SELECT doc_id, 0, max(i) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM e) GROUP BY doc_id HAVING bool_or(y <> '')),
h AS (SELECT r.doc_id, r.i, r.j, string_agg(c.y, ' ' ORDER BY c.i) AS span FROM r JOIN c ON c.doc_id = r.doc_id AND c.i BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j),
v AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS k FROM h),
z AS (SELECT DISTINCT c.doc_id, c.i FROM c JOIN v ON v.doc_id = c.doc_id AND c.i BETWEEN v.i AND v.j WHERE v.k > 1)
SELECT d.doc_id, count(c.i) AS n_pieces, count(z.i) AS n_removed,
  sha256(coalesce(string_agg(c.x, '' ORDER BY c.i) FILTER (z.i IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = c.doc_id AND z.i = c.i GROUP BY d.doc_id
"""
