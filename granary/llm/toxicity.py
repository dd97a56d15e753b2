"""Toxicity scores from a subword-bag model: character n-gram vectors, averaged, into a linear softmax.

The n-gram vectors and the softmax weights are trained together in numpy on a bounded sample of
labelled texts. A text is read in windows of a few words, so that one insult in a long text is not
averaged away; a text scores as its worst window. A window is the unit of training too: in a toxic
text only the window that the model finds worst carries the label, in a clean one every window does.

Since score(window) = softmax(W . mean of n-gram vectors), the trained model folds into one number
for each n-gram bucket; scoring is a gather and two running sums over the bytes of a text.

Defined results: null and empty texts, and texts without letters, score as the model's bias alone.
A null doc_id counts as held out. Repeated rows each get their score. Several labels of one doc_id
count as their largest, and several texts as the least of them; null labels are left out. With no usable labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import named, unused, with_new
from .textkit import U64, blocks


@dataclass(frozen=True)
class Params:
    """max_toxic and max_clean bound the sample of labelled texts that the driver trains on, max_train_bytes their bytes (twice the
    characters); texts of over a twentieth of these are not learned from."""

    max_toxic: int = 1500
    max_clean: int = 2500
    max_train_bytes: int = 12_000_000
    grams: tuple[int, ...] = (3, 4, 5, 6)
    bucket_bits: int = 17
    dim: int = 8
    window: int = 12
    step: int = 6
    rounds: int = 5
    epochs: int = 2
    rate: float = 0.5
    seed: int = 7


_FOLD = np.full(256, 0x20, np.uint8)  # all but letters separates; A-Z to a-z; bytes of longer characters stay
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_buckets(data: np.ndarray, grams: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the n-grams of words with their edges marked: (first byte, bucket).

    An n-gram of at most eight bytes is packed into one integer, so only the bucketing hashes.
    """
    b = _FOLD[data]
    letters = np.zeros(len(b) + 1, np.int64)
    np.cumsum(b != 0x20, out=letters[1:])
    wide = b.astype(U64)
    key = wide.copy()
    for n in range(2, max(grams) + 1):
        if len(b) < n:
            return
        key = (key[: len(b) - n + 1] << U64(8)) | wide[n - 1 :]
        if n in grams:
            m = len(key)
            at = np.flatnonzero(letters[n - 1 : n - 1 + m] - letters[1 : 1 + m] == n - 2)
            k = key[at] + U64(n)
            k ^= k >> U64(31)
            yield at, ((k * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def word_starts(data: np.ndarray) -> np.ndarray:
    """First byte of each run of letters."""
    inside = (_FOLD[data] != 0x20).astype(np.int8)
    return np.flatnonzero(np.diff(inside, prepend=0) == 1)


def windows_of(data: np.ndarray, starts: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first byte, end byte) of every window; a text has one at least. The space behind a text is not part of it:
    n-grams that begin there are the next text's."""
    first = word_starts(data)
    at = np.searchsorted(first, starts)
    n = np.maximum(1, -(-np.maximum(np.diff(at) - p.window, 0) // p.step) + 1)
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    a, b = at[text] + k * p.step, at[text] + k * p.step + p.window
    first = np.append(first, len(data))
    lo = np.where(k == 0, starts[text], first[np.minimum(a, len(first) - 1)] - 1)
    hi = np.where(b >= at[text + 1], starts[text + 1] - 1, first[np.minimum(b, len(first) - 1)])
    return text, np.maximum(lo, 0), hi


def score_texts(texts: pa.Array, table: np.ndarray, bias: float, p: Params) -> np.ndarray:
    """Probability of toxic for every text: that of its worst window."""
    out = np.zeros(len(texts))
    for row, data, starts in blocks(texts):
        weight, count = np.zeros(len(data) + 1), np.zeros(len(data) + 1)
        for at, bucket in gram_buckets(data, p.grams, p.bucket_bits):
            weight[at + 1] += table[bucket]
            count[at + 1] += 1
        np.cumsum(weight, out=weight)
        np.cumsum(count, out=count)
        text, lo, hi = windows_of(data, starts, p)
        z = (weight[hi] - weight[lo]) / np.maximum(count[hi] - count[lo], 1) + bias
        worst = np.maximum.reduceat(z, np.searchsorted(text, np.arange(len(starts) - 1)))
        out[row : row + len(worst)] = 1 / (1 + np.exp(-np.clip(worst, -40, 40)))
    return out


def train(texts: list[str], toxic: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """(folded weight of every n-gram bucket, bias), from texts with labels 0 and 1."""
    size, rng = 1 << p.bucket_bits, np.random.default_rng(p.seed)
    if len(texts) == 0 or toxic.min() == toxic.max():
        return np.zeros(size), 30.0 if len(texts) and toxic.max() == 1 else -30.0
    text_of, begin, lens, held = [], [], [], 0
    # every n-gram once: windows that overlap are stretches of the same ones. A place holds one of each length at most; what is not written takes no memory
    ids = np.empty(len(p.grams) * sum(len(t.encode()) + 1 for t in texts), np.int32)
    for first, data, starts in blocks(pa.array(texts, pa.string())):
        at, bucket = (np.concatenate(x) for x in zip(*gram_buckets(data, p.grams, p.bucket_bits), strict=True)) if len(data) >= max(p.grams) else (np.zeros(0, np.int64),) * 2
        order = np.argsort(at, kind="stable")
        at, bucket = at[order], bucket[order].astype(np.int32)
        text, lo, hi = windows_of(data, starts, p)
        a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
        ids[held : held + len(bucket)] = bucket
        begin.append(a + held)
        lens.append(b - a)
        text_of.append(text + first)
        held += len(bucket)
    begin, lens, text_of = (np.concatenate(x) for x in (begin, lens, text_of))
    keep = lens > 0
    begin, lens, text_of = begin[keep], lens[keep], text_of[keep]
    if not len(lens):
        return np.zeros(size), -30.0
    label = toxic[text_of]
    emb, w, bias = rng.normal(0, 0.1, (size, p.dim)), rng.normal(0, 0.5, p.dim), 0.0
    g_emb, g_w, g_b = np.full(size, 1e-2), np.full(p.dim, 1e-1), 1e-1
    positive, negative = np.flatnonzero(label == 1), np.flatnonzero(label == 0)

    def folded(rows: np.ndarray) -> np.ndarray:
        table = emb @ w
        return np.array([table[ids[a : a + n]].mean() for a, n in zip(begin[rows], lens[rows], strict=True)]) + bias

    for step in range(p.rounds):
        if step == 0:
            pos = positive
        else:  # the worst window of each toxic text
            z = folded(positive)
            order = np.lexsort((-z, text_of[positive]))
            pos = positive[order][np.unique(text_of[positive][order], return_index=True)[1]]
        many = min(len(negative), max(12 * len(pos), 8000) if step else 2 * len(pos))
        neg = rng.choice(negative, many, replace=False)
        if step > 1:  # and the clean windows that look worst
            hard = rng.choice(negative, min(len(negative), 40_000), replace=False)
            neg = np.union1d(neg, hard[np.argsort(-folded(hard))[: 2 * len(pos)]])
        share = len(neg) / len(pos)
        for _ in range(p.epochs + (step > 0)):
            rows = rng.permutation(np.concatenate([neg, np.repeat(pos, max(1, round(share / 4)))]))
            for batch in np.array_split(rows, max(1, len(rows) // 512)):
                n = lens[batch]
                gather = np.repeat(begin[batch] - np.cumsum(n) + n, n) + np.arange(n.sum())
                bucket = ids[gather]
                cut = np.cumsum(n) - n
                mean = np.add.reduceat(emb[bucket], cut, axis=0) / n[:, None]
                y = label[batch]
                err = 1 / (1 + np.exp(-np.clip(mean @ w + bias, -40, 40))) - y
                gw, gb = mean.T @ err / len(batch), err.mean()
                pull = np.bincount(bucket, np.repeat(err / n, n), size) / 4
                g_emb += (pull**2) * (w @ w)
                emb -= (p.rate * pull / np.sqrt(g_emb))[:, None] * w
                g_w += gw**2
                g_b += gb**2
                w -= p.rate * gw / np.sqrt(g_w) * 0.2
                bias -= p.rate * gb / np.sqrt(g_b) * 0.2
    return emb @ w, float(bias)


def remainder(doc_id: Column) -> Column:
    """The fold of a document, 0 to 4; 0 (and a null doc_id) is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), learn: Column | None = None) -> tuple[np.ndarray, float]:
    """Trains on at most ``max_toxic + max_clean`` labelled documents (their whole texts, in an order by
    hash, up to ``max_train_bytes``) of those that ``learn``, a condition on doc_id, lets in."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if learn is not None:
        known = known.where(learn)
    order = F.xxhash64(F.lit(p.seed), "doc_id")
    some = known.where("toxic = 1").orderBy(order, "doc_id").limit(p.max_toxic).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(p.max_clean))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")  # bounded by the two limits
    texts = texts.where(F.length("text") * 2 <= p.max_train_bytes // 20).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    size = F.sum(F.length("text") * 2.0).over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    texts = texts.withColumn("upto", size).where(F.col("upto") <= p.max_train_bytes).orderBy(order, "doc_id")
    rows = texts.select("text", "toxic").collect()
    return train([r.text for r in rows], np.array([int(r.toxic) for r in rows]), p)


def score(docs: DataFrame, model: tuple[np.ndarray, float], p: Params = Params(), name: str = "score") -> DataFrame:
    """All columns of ``docs`` and its score; an existing column of that name is replaced."""
    table, bias = model
    share = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # 2**bucket_bits numbers, whatever the input
    docs = docs.select(*(named(c) for c in docs.columns if c.lower() != name.lower()))
    keep, at = len(docs.columns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = share.value
        for batch in batches:
            found = score_texts(batch.column(at), weights, bias, p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, f"c{keep}"])

    return with_new(docs, run, keep, [T.StructField(name, T.DoubleType())])


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5, p: Params = Params()) -> DataFrame:
    """``docs`` without those that score ``least`` or more."""
    name = unused(docs, "score")
    return score(docs, model, p, name).where(F.col(name) < least).select(*map(named, docs.columns))


def op9_toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    fold = remainder(F.col("doc_id"))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, p, fold != 0), p)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
