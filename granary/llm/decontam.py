"""Benchmark decontamination: passages of documents within a quarter of a benchmark item's length in word edits.

Items of up to ``WHOLE`` words are looked for as they are. Longer ones are cut into parts of about fifty words: of a match within a quarter
of the item's length, one part at least is within a quarter of its own. Parts that are found say where the item would lie (places are
gathered by document, item and diagonal), and the whole item is verified there.

Items (and parts) fall into bands of length. A window of a document is as long as a band's items. Windows that cannot match are
left out by counting: e edits leave at least L - 1 - 2e of an item's word pairs, so a window with fewer pairs
known from the band's items is no match. (The known pairs travel as a table of 2**18 bit masks, whatever the number of items.)

The other windows are embedded by random walks (Chakraborty, Goldenberg, Koucky): at every step the current word is put out and a
hash of step and word decides whether to go on to the next word, so strings a few edits apart fall back
into step and their embeddings differ in few places. ``KEYS`` keys, each of ``BITS`` sampled places, are joined with
those of the items. Pairs that meet are verified by the exact least edit distance of the item to any part of
the window with its surroundings. Tests measure the recall of the sampling; it was over 0.99 for windows at the limit.

Items under ``LEAST`` words are too short to embed. They may have one edit at most, so one half of theirs (or all of it) stands in a match as it
is: hashes of those few words are joined, and the least edit distance decides. This finds all matches.

Defined results: null and empty items match nothing, as do null, empty and blank texts. Letter case
A-Z and white space do not count. Rows with a null doc_id are kept. Rows alike in doc_id count together. Equal items all match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean, unused, written
from .textkit import U64, blocks, mix, ngrams, salted, words

LEAST = 8
#: Items over WHOLE words are cut into parts of PART words at most.
WHOLE, PART = 60, 48
WALKS, KEYS, BITS = 6, 36, 2
MASK_BITS = 18
CELLS = 2_000_000
#: Items up to this number are sent to every task (36 keys of 24 bytes each); more are joined by shuffling.
MAX_SENT = 20_000


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return n // 4


def bands() -> list[tuple[int, int]]:
    """(shortest, longest) of each band; there are 31, and the last takes all that is longer."""
    out, lo = [], LEAST
    while len(out) < 30:
        hi = lo + max(1, lo // 6)
        out.append((lo, hi))
        lo = hi + 1
    return [*out, (lo, 1 << 30)]


BANDS = bands()
_ENDS = np.array([hi for _, hi in BANDS])


def band_of(n: int) -> int:
    return int(np.searchsorted(_ENDS, n))


def _shape(band: int, longest: int) -> tuple[int, int, int, int]:
    """(shortest, longest, stride, surroundings) of a band's windows."""
    lo, hi = BANDS[band]
    hi = min(hi, longest)
    stride = max(1, lo // 8)
    # a window that passes the count holds half of a match, so the whole match lies this near
    return lo, hi, stride, 3 * hi // 4 + allowed(hi) + 1


def keys(x: np.ndarray, band: int) -> np.ndarray:
    """(rows, KEYS) keys of rows of word hashes, all of one band, padded at the end."""
    lo = BANDS[band][0]
    steps = int(1.8 * lo)
    out = np.zeros((len(x), KEYS), U64)
    at = np.arange(len(x))
    each = KEYS // WALKS
    for walk in range(WALKS):
        salt, odd = salted(steps, 900 + band * 64 + walk), salted(steps, 5000 + band * 64 + walk) | U64(1)
        picks = np.random.default_rng(band * 64 + walk).integers(0, steps, (each, BITS))
        wanted, seen = {int(j) for j in picks.ravel()}, {}
        i = np.zeros(len(x), np.int64)
        for j in range(steps):
            word = x[at, np.minimum(i, x.shape[1] - 1)]
            if j in wanted:
                seen[j] = word
            i += (((word ^ salt[j]) * odd[j]) >> U64(63)).view(np.int64)  # hashes of words are mixed already
        for k in range(each):
            h = np.full(len(x), (band * WALKS + walk) * each + k, U64)
            for j in picks[k].tolist():
                h = mix(h * U64(0x9E3779B97F4A7C15) + seen[j])
            out[:, walk * each + k] = h
    return out


def _side_by_side(items: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n, most, wide = len(items), max(map(len, items)), max(map(len, parts))
    a, b = np.zeros((n, most), U64), np.full((n, wide), 1, U64)
    for k, (x, y) in enumerate(zip(items, parts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    return a, b


def lacking(items: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """How many words of each item do not occur in its part at all: no edit distance is less."""
    a, b = _side_by_side(items, parts)
    lengths, out = np.array([len(x) for x in items]), np.zeros(len(items), np.int64)
    for i in range(a.shape[1]):
        out += (i < lengths) & ~(b == a[:, i : i + 1]).any(axis=1)
    return out


def distances(items: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    """Least edit distance of each item to any run of its part, by rows of the usual table for all pairs together."""
    a, b = _side_by_side(items, parts)
    n, most, wide = len(items), a.shape[1], b.shape[1]
    lengths = np.array([len(x) for x in items])
    cut = np.arange(wide + 1)[None, :] > np.array([len(y) for y in parts])[:, None]
    row, out, place = np.zeros((n, wide + 1), np.int32), np.zeros(n, np.int32), np.arange(wide + 1, dtype=np.int32)
    for i in range(1, most + 1):
        new = row + 1
        new[:, 0] = i
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (a[:, i - 1 : i] != b))
        row = np.minimum.accumulate(new - place, axis=1) + place
        done = lengths == i
        if done.any():
            out[done] = np.where(cut[done], 1 << 20, row[done]).min(axis=1)
    return out


def _source(docs: DataFrame, name: str) -> DataFrame:
    return docs.select(F.col(name).cast("bigint").alias(name), F.col("text").cast("string").alias("text")).where("text is not null")


def parts_of(n: int) -> list[tuple[int, int]]:
    """(first word, end) of the parts of an item of n words: of even size, and only one up to ``WHOLE`` words."""
    k = 1 if n <= WHOLE else -(-n // PART)
    ends = [n * i // k for i in range(k + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, whole, piece, first, size, band, words, keys, pairs): a row a part of each item that is long enough to embed, and for those of several
    parts one of band -1 with all words. ``whole`` tells items of one id apart, ``piece`` their parts."""
    kinds = {"whole": pa.int64(), "piece": pa.int64(), "first": pa.int32(), "size": pa.int32(), "band": pa.int32(), "words": pa.binary(), "keys": pa.list_(pa.int64()), "pairs": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for begin, data, starts in blocks(batch.column("text")):
                h, _, _, at = words(data, starts)
                for k in range(len(starts) - 1):
                    w = h[at[k] : at[k + 1]]
                    if len(w) < LEAST:
                        continue
                    whole = _identity(w)
                    parts = parts_of(len(w))
                    for a, b in parts:
                        x, band = w[a:b], band_of(b - a)
                        piece = int(mix(np.array([whole], np.int64).view(U64) + U64(a))[0].view(np.int64))
                        rows.append((begin + k, whole, piece, a, len(w), band, x.tobytes(), keys(np.append(x, U64(0))[None, :], band)[0].view(np.int64), np.unique(ngrams(x, 2) >> U64(64 - MASK_BITS)).astype(np.int32)))
                    if len(parts) > 1:
                        rows.append((begin + k, whole, whole, 0, len(w), -1, w.tobytes(), [], []))
            ids = batch.column("item_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values(), 1))], names=["item_id", *kinds])

    return _source(benchmark, "item_id").mapInArrow(lean(run), "item_id bigint, whole bigint, piece bigint, first int, size int, band int, words binary, keys array<bigint>, pairs array<int>")


def _identity(w: np.ndarray) -> int:
    """A hash of a sequence of words."""
    return int(mix(np.array([(mix(w + np.arange(len(w), dtype=U64))).sum(dtype=U64)], U64))[0].view(np.int64))


def _version(w: np.ndarray) -> int:
    """Tells texts of one doc_id apart."""
    return int(mix(w.sum(dtype=U64, keepdims=True))[0].view(np.int64))


def _texts_at(at: np.ndarray, places: np.ndarray, wide: int) -> list[int]:
    """Texts (of first words ``at``) that stretches of ``wide`` words from these places touch."""
    first = np.searchsorted(at, places, side="right") - 1
    last = np.searchsorted(at, places + wide, side="right") - 1
    change = np.zeros(len(at) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(last, len(at) - 2) + 1, -1)
    touched = np.cumsum(change)[: len(at) - 1] > 0
    return np.flatnonzero(touched).tolist()


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, place, version, band, words, keys) of every window that may match."""
    known = items.select(F.explode("pairs").alias("pair"), "band").groupBy("pair").agg(F.expr("bit_or(shiftleft(1, band))").alias("mask")).collect()  # 2**MASK_BITS rows at most
    mask = np.zeros(1 << MASK_BITS, np.uint32)
    for r in known:
        mask[r["pair"]] = r["mask"] & 0xFFFFFFFF
    lengths = {r["band"]: r["n"] for r in items.groupBy("band").agg(F.max(F.length("words") / 8).cast("int").alias("n")).collect()}
    share = docs.sparkSession.sparkContext.broadcast((mask, lengths))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, lengths = share.value
        shapes = {b: _shape(b, n) for b, n in lengths.items()}
        need = {b: min((n - 1 - 2 * allowed(n) for n in range(lo, min(hi, lo + 4) + 1))) for b, (lo, hi, _, _) in shapes.items()}
        least, widest = min(need.values(), default=0), max((hi + allowed(hi) for _, hi, _, _ in shapes.values()), default=1)
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, data, starts in blocks(batch.column("text")):
                h, _, _, at = words(data, starts)
                hit = mask[(ngrams(h, 2) >> U64(64 - MASK_BITS)).astype(np.int64)]
                some = np.zeros(len(hit) + 1, np.int64)
                np.cumsum(hit != 0, out=some[1:])
                # texts in which some stretch as long as the longest window has enough known pairs of any band
                ends = np.minimum(np.arange(len(hit)) + widest, len(hit))
                dense = np.flatnonzero(some[ends] - some[:-1] >= least)
                for k in _texts_at(at, dense, widest):
                    a, b = int(at[k]), int(at[k + 1])
                    w, own = h[a:b], hit[a : max(a, b - 1)]
                    for band, (lo, hi, stride, around) in shapes.items():
                        total = np.zeros(len(own) + 1, np.int64)
                        np.cumsum(own >> np.uint32(band) & np.uint32(1), out=total[1:])
                        p = np.arange(len(own))
                        good = np.flatnonzero(total[np.minimum(p + hi + allowed(hi) - 1, len(own))] - total[p] >= need[band])
                        if not len(good):
                            continue
                        new = np.r_[True, np.diff(good) > 1]
                        offset = np.arange(len(good)) - np.maximum.accumulate(np.where(new, np.arange(len(good)), 0))
                        p = good[(offset % stride == 0) | np.r_[new[1:], True]]
                        padded = np.concatenate([w, np.zeros(hi + 1, U64)])
                        version = _version(w)
                        parts = [w[max(0, q - around) : q + hi + around].tobytes() for q in p.tolist()]
                        waiting.setdefault(band, []).append((np.full(len(p), ids[first + k]), p, np.full(len(p), version), parts, padded[p[:, None] + np.arange(hi + 1)]))
                        if sum(len(x[1]) for x in waiting[band]) >= 4096:
                            yield ready(band, waiting.pop(band))
        for band, found in waiting.items():
            yield ready(band, found)

    def ready(band: int, found: list[tuple]) -> pa.RecordBatch:
        """Windows of a band with their keys, many at a time."""
        ids, p, version = (np.concatenate([x[i] for x in found]) for i in range(3))
        k = keys(np.concatenate([x[4] for x in found]), band).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, KEYS, dtype=np.int32)), pa.array(k.ravel()))
        columns = [pa.array(ids), pa.array(p), pa.array(version), pa.array(np.full(len(p), band, np.int32)), pa.array([y for x in found for y in x[3]], pa.binary()), lists]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "version", "band", "words", "keys"])

    return _source(docs, "doc_id").where("doc_id is not null and text <> ''").mapInArrow(lean(run), "doc_id bigint, place bigint, version bigint, band int, words binary, keys array<bigint>")


def _verified(pairs: DataFrame, *own: str) -> DataFrame:
    """(own, distance) of the pairs (own, words, item) that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.add(*(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) // 8 for c in ("item", "words")))
            at = 0
            while at < len(batch):  # so many pairs at a time that their tables hold ``CELLS`` words
                n = np.arange(1, min(512, len(batch) - at) + 1)
                fits = int((np.maximum.accumulate(cells[at : at + 512]) * n <= CELLS).sum())
                part = batch.slice(at, max(1, fits))
                at += len(part)
                items, parts = ([np.frombuffer(x, U64) for x in part.column(c).to_pylist()] for c in ("item", "words"))
                most = np.array([allowed(len(x)) for x in items])
                may = np.flatnonzero(lacking(items, parts) <= most)
                d = np.full(len(items), 1 << 20, np.int32)
                if len(may):
                    d[may] = distances([items[i] for i in may], [parts[i] for i in may])
                ok = pa.array(d <= most)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(d)], names=[*own, "distance"]).filter(ok)

    return pairs.select(*own, "words", "item").mapInArrow(lean(run), ", ".join([*(f"{c} bigint" for c in own), "distance int"]))


def _regions(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, whole, words): of documents where parts of long items were found, the words where the whole items would lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, starts in blocks(batch.column("text")):
                h, _, _, at = words(data, starts)
                rows: list[tuple] = []
                for k in range(len(starts) - 1):
                    w = h[at[k] : at[k + 1]]
                    version = _version(w) if len(w) else 0
                    for x in batch.column("hits")[begin + k].as_py():
                        if x["version"] == version:
                            slack = allowed(x["size"]) + 3 * PART
                            rows.append((batch.column("doc_id")[begin + k].as_py(), x["item_id"], x["whole"], w[max(0, x["low"] - slack) : max(0, x["high"] + x["size"] + slack)].tobytes()))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "whole", "words"])

    # parts whose places agree but for the item's edits lie on one diagonal
    near = F.floor(F.col("start") / (F.floor(F.col("size") / 4) + 3 * PART))
    places = hits.groupBy("doc_id", "version", "item_id", "whole", "size", near.alias("near")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    listed = places.groupBy("doc_id").agg(F.collect_list(F.struct("version", "item_id", "whole", "size", "low", "high")).alias("hits"))  # at most a document's own length over 64 for each item
    return _source(docs, "doc_id").join(listed, "doc_id").mapInArrow(lean(run), "doc_id bigint, item_id bigint, whole bigint, words binary")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance): items that documents hold, with the fewest word edits."""
    items = written(_items(benchmark))
    pieces, long = items.where("band >= 0"), items.where("band < 0").select("item_id", "whole", F.col("words").alias("item"))
    windows = written(_windows(docs, pieces))
    of_items = pieces.select(F.explode("keys").alias("key"), "item_id", "piece").distinct()
    if items.count() <= MAX_SENT:
        of_items = F.broadcast(of_items)
    own = ["doc_id", "version", "place", "band"]
    met = windows.select(*own, F.explode("keys").alias("key")).join(of_items, "key").select(*own, "item_id", "piece").distinct()
    of_piece = pieces.select("item_id", "piece", "whole", F.col("first").cast("bigint").alias("first"), F.col("size").cast("bigint").alias("size"), F.col("words").alias("item"))
    pairs = met.join(windows.select(*own, "words"), own).join(of_piece, ["item_id", "piece"])
    out = [_verified(pairs.where(F.col("size") <= WHOLE), "doc_id", "item_id")]
    if not long.isEmpty():
        hits = _verified(pairs.where(F.col("size") > WHOLE).withColumn("start", F.col("place") - F.col("first")), "doc_id", "version", "item_id", "whole", "size", "start")
        out.append(_verified(_regions(docs, hits).join(long, ["item_id", "whole"]), "doc_id", "item_id"))
    short = written(_short_items(benchmark))
    if not short.isEmpty():
        out.append(_verified(_short_places(docs, short), "doc_id", "item_id"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _short_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, grams, key, item): items under ``LEAST`` words by the words that stand in every match as they are, or in every one where the others do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for begin, data, starts in blocks(batch.column("text")):
                h, _, _, at = words(data, starts)
                for k in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < LEAST)).tolist():
                    w = h[at[k] : at[k + 1]]
                    halves = [w] if allowed(len(w)) == 0 else [w[: len(w) // 2], w[len(w) // 2 :]]
                    rows += [(begin + k, len(x), int(ngrams(x, len(x))[0].view(np.int64)), w.tobytes()) for x in halves]
            ids = batch.column("item_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()), 1))], names=["item_id", "grams", "key", "item"])

    return _source(benchmark, "item_id").mapInArrow(lean(run), "item_id bigint, grams int, key bigint, item binary")


def _short_places(docs: DataFrame, short: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, item): places of documents that hold such words of an item. What is known of the items in each task are 2**18 bit masks."""
    known = short.groupBy(F.shiftrightunsigned("key", 64 - MASK_BITS).cast("int").alias("bits")).agg(F.expr("bit_or(shiftleft(1, grams))").alias("mask")).collect()  # 2**MASK_BITS rows at most
    mask = np.zeros(1 << MASK_BITS, np.int32)
    for r in known:
        mask[r["bits"]] = r["mask"]
    share, sizes = docs.sparkSession.sparkContext.broadcast(mask), range(1, LEAST // 2 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = share.value
        for batch in batches:
            for begin, data, starts in blocks(batch.column("text")):
                h, _, _, at = words(data, starts)
                ids = batch.column("doc_id").slice(begin, len(starts) - 1)
                for grams in sizes:
                    keys = ngrams(h, grams)
                    p = np.flatnonzero(mask[(keys >> U64(64 - MASK_BITS)).astype(np.int64)] >> grams & 1)
                    text = np.searchsorted(at, p, side="right") - 1
                    p, text = p[p + grams <= at[text + 1]], text[p + grams <= at[text + 1]]
                    around = [h[max(a, q - LEAST) : min(b, q + 2 * LEAST)].tobytes() for q, a, b in zip(p.tolist(), at[text].tolist(), at[text + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(np.full(len(p), grams, np.int32)), pa.array(keys[p].view(np.int64)), pa.array(around, pa.binary())], names=["doc_id", "grams", "key", "words"])

    places = _source(docs, "doc_id").where("doc_id is not null and text <> ''").mapInArrow(lean(run), "doc_id bigint, grams int, key bigint, words binary")
    few = F.broadcast(short) if short.count() <= MAX_SENT else short
    return places.join(few, ["grams", "key"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows with a null doc_id are kept."""
    leak = unused(docs, "leak")
    found = leaks(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(leak), "left_anti")


def op6_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: whether it holds a benchmark item, and which."""
    found = leaks(docs, benchmark).groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.min("distance").alias("least_distance"))
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("_d"), "left").select("doc_id", F.col("_d").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "least_distance")
