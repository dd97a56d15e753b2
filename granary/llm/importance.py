"""Importance resampling: documents are drawn in proportion to how much likelier their n-grams are in a target text.

N-grams are counted in hashed buckets of a corpus and of a target. A bucket's gain is the log ratio of its two smoothed shares; a
document's weight is its mean gain, and Gumbel noise from a keyed hash of its id turns "the highest scores" into a draw without replacement.

Scanning: bytes other than letters, digits and those of longer characters are separators, of which each run becomes one space; A-Z
are folded. ``regex`` then walks over that text with overlapping matches, held by lookarounds to whole words, so every
n-gram is one span of the text and its CRC is taken from those very bytes.

The texts are read once: what is kept of a document are its buckets and their counts, as a written table, from which the corpus is counted
(at most a row a bucket and task is shuffled) and the documents are weighed.

Defined results: null texts, empty ones and those without words have no features and weight 0. Rows without a doc_id are counted and weighed but
have neither score nor rank. Repeated rows are documents of their own; equal scores of one doc_id have ranks in any order. An empty
corpus gives an empty result, and an empty target leaves every bucket at its smoothed share. Further columns do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.ranks import numbered

from .scratch import written

_BREAK = 0x20
_FOLD = np.full(256, _BREAK, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD = _FOLD.tobytes()


@dataclass(frozen=True)
class Params:
    """``grams``: n-grams of 1 to so many words. ``buckets`` bounds what is sent to the driver and to each task."""

    grams: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    key: str = "2024"


def scanner(n: int) -> regex.Pattern:
    """Matches of n words between single spaces, to be looked for with overlaps."""
    return regex.compile(rb"(?<![^ ])[^ ]++" + rb"(?: [^ ]++){%d}" % (n - 1) * (n > 1) + rb"(?![^ ])")


def collapsed(text: bytes) -> bytes:
    """A-Z folded and each run of separators a single space."""
    return b" ".join(text.translate(_FOLD).split())


def buckets_of(text: bytes, scanners: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every n-gram with repeats)."""
    plain, crc = collapsed(text), zlib.crc32
    each = np.fromiter((crc(m[0]) for s in scanners for m in s.finditer(plain, overlapped=True)), np.int64)
    return plain.count(b" ") + bool(plain), each % buckets


def features(docs: DataFrame, p: Params, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, bucket, n): for each row its buckets and their counts."""
    grams, buckets = p.grams, p.buckets
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [scanner(n) for n in range(1, grams + 1)]
        for b in batches:
            found, n_words, n_features = [(np.zeros(0, np.int64),) * 2], [], []
            for t in b.column(1).cast(pa.binary()):
                words, each = buckets_of(t.as_py() or b"", scanners, buckets)
                n_words.append(words)
                n_features.append(len(each))
                found.append(np.unique(each, return_counts=True))
            ends = pa.array(np.cumsum([len(k) for k, _ in found]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in found]), pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists], names=[doc, "n_words", "n_features", "bucket", "n"])

    return docs.select(doc, text).mapInArrow(run, f"`{doc}` {kind}, n_words bigint, n_features bigint, bucket array<int>, n array<int>")


def counts(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows; each task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return found.select("bucket", "n").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) in doubles. The driver takes a row a bucket."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    rows = both.crossJoin(F.broadcast(sums))  # one row
    gain = F.floor(1000 * F.ln((t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))))
    out = np.zeros(buckets, np.int64)
    for r in rows.select("bucket", gain.alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weighed(found: DataFrame, gain: np.ndarray, doc: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain over each row's features."""
    kind = found.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = b.column(3), b.column(4)
            sums = np.zeros(len(keys.flatten()) + 1, np.int64)
            np.cumsum(gain[keys.flatten().to_numpy()] * n.flatten().to_numpy().astype(np.int64), out=sums[1:])
            ends = np.cumsum(np.concatenate([[0], keys.value_lengths().to_numpy(zero_copy_only=False)]))
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(b.column(2).to_numpy(), 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight)], names=[doc, "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"`{doc}` {kind}, n_words bigint, n_features bigint, weight bigint")


def drawn(docs: DataFrame, target: DataFrame, p: Params = Params(), doc: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null for those not drawn.

    Of the N rows with at least ``least_words`` words, the floor(percent * N / 100) highest scores are drawn, equal ones by doc_id."""
    found = written(features(docs, p, doc, text))
    aimed = features(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), p)
    rows = weighed(found, gains(counts(found, p.buckets), counts(aimed, p.buckets), p.buckets), doc)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.key}:"), F.col(doc).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))))
    may = (F.col("n_words") >= p.least_words) & F.col(doc).isNotNull()
    names = [doc, "n_words", "n_features", "weight", "score"]
    ranked = numbered(rows.where(may), F.desc("score"), F.asc(doc), place="rank")
    ranked = ranked.select(*names, F.when(F.col("rank") <= F.floor(F.col("total") * p.percent / 100), F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where(~may).select(*names, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn."""
    ids = drawn(docs, target, p).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")


def op12_importance(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return drawn(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 byte by byte, with its table made from the polynomial.
ORACLE = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
dw AS (SELECT r, unnest({_WORDS.format("text")}) AS w FROM d), bw AS (SELECT unnest({_WORDS.format("text")}) AS w FROM benchmark),
hexes AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295::BIGINT) % 10000 AS bucket FROM hexes, tab),
db AS (SELECT r, bucket, count(*) AS n FROM dw JOIN b USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM db GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (w) GROUP BY 1),
tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot),
f AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM db JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
k AS (SELECT doc_id, n_features, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM y WHERE n_features >= 20 AND doc_id IS NOT NULL)
SELECT y.doc_id, y.n_features, y.weight, y.score, k.k AS rank FROM y LEFT JOIN k ON k.doc_id = y.doc_id AND k.n_features = y.n_features AND k.k <= 10 * k.n // 100"""
