"""Self join of texts on the Jaccard similarity of their word n-grams, by PartEnum signatures.

Sets of sizes a <= b can only reach similarity t when b <= a / t, so sizes fall into bands of that ratio and a
set takes part in two instances: that of its own band and that of the next. In an instance with largest size r
two similar sets differ in at most k = 2r(1-t)/(1+t) elements. The domain of n-grams is partitioned by hash into
n1 first-level parts of three cells each; every subset of two cells of a part makes one signature, the hash of
what the set has in them. A part with at most one differing element leaves two cells, hence one signature,
in common. A part counts for a set when two of its cells hold something; with q such parts, 2q > k makes a shared,
non-empty signature certain (it is enough that one set of a pair has so many). A set that misses the count
emits again with other seeds, and after three its single elements; small sets emit their elements at once.

Large sets would need hundreds of parts. They emit the first ``MAX_PARTS`` only: a pair exactly at 0.75 shares
a signature in each with probability 0.52, so it is missed with probability 0.48**28 < 2e-9, fewer above it.

Equal sets are one node, named by a hash of the set, so copies cost one row a task and never meet in pairs.
Rows of a signature are read as a stream in the order of their nodes. The first ``FEW`` + 1 all meet; a later one meets the first
only, so a large signature makes a pair a row. That order is the same in all signatures: the sets of a family share few
firsts between them, so a set makes few pairs however many signatures it has. First each node is checked with two earlier ones, those of the most
small and of the most large signatures in common, which makes classes of most families by two links a node at most. Then all pairs that met in small
signatures are checked where they are still of different classes. Their classes are formed; many links between two classes count as one.

A link inside a class changes nothing, so what is left are pairs of different classes that share large signatures only. The
nodes of every large signature that more than one class has (and a few more, see ``_mixed``) are joined once more, exactly: the n-grams of each are ordered
from rare to frequent (by counts of hash ranges; any one order is right, this one keeps groups small), and two similar sets share the first
n-gram they have in common within the rarest quarter and one of each. N-grams of one row or one class are left out first. Sizes, places and sketches rule out most pairs
where the rows of an n-gram meet, the texts decide.
In first passes the sets that share an n-gram meet only so many as ``FIRST`` says of the largest class there, others for each n-gram, which joins
most of what belongs together by a number of pairs in proportion to the rows; then all pairs that are still of different classes meet.
An n-gram with no more rows than such a pass lets meet is done with it.
Pairs whose 128-byte sketches are six standard deviations too far apart (a chance in the order of 1e-9 for a pair at 0.75) are left out, all others are checked on the texts.

Defined results: null, empty and blank texts have no n-grams and are linked with nothing; texts shorter than
n words are one n-gram. Repeated rows are one class. Rows with a null doc_id are compared, but name no class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import discard, lean, named, written
from .textkit import U64, mix, salted, shingle_sets

MAX_PARTS = 28
FEW, FIRST = 3, (8, 100)
SMALL = 16
#: Smallest set with a sketch, and the standard deviations that a pair's agreement may fall short.
SKETCHED, APART, BINS = 24, 6, 128
#: Bits of the table of first nodes, in which two may share a bit.
FIRSTS = 1 << 24
#: Ranges of hashes whose n-grams are counted together, and pairs held at a time.
BUCKETS, _PAIRS, _COMPARED = 1 << 18, 1 << 20, 1 << 16
_SEEN = 100_000


def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """First size of each band; a band's last size is the largest that its first can be similar to."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


class Signer:
    """Signatures of one set of 64-bit hashes after another."""

    def __init__(self, percent: int = 75):
        self.percent, self.first = percent, bands(percent)
        self.small = SMALL * 100 // percent  # the largest size that a set of SMALL can be similar to

    def parts(self, instance: int) -> tuple[int, int]:
        """(k, n1) of an instance."""
        r = int(self.first[instance + 1]) - 1
        k = 2 * r * (100 - self.percent) // (100 + self.percent)
        return k, int(1.35 * (k + 1) / 2) + 2

    def cells(self, h: np.ndarray, instance: int, seed: int) -> tuple[np.ndarray, bool]:
        """Signatures in one instance with one seed, and whether they are certain to suffice."""
        k, n1 = self.parts(instance)
        parts = min(n1, MAX_PARTS)
        g = mix(h + salted(1, instance * 64 + seed)[0])
        cell = ((g >> U64(24)) % U64(n1 * 3)).astype(np.int64)
        if parts < n1:
            inside = cell < parts * 3
            cell, g = cell[inside], g[inside]
        order = np.argsort(cell, kind="stable")
        count = np.bincount(cell, minlength=parts * 3)
        total = np.zeros(len(cell) + 1, U64)
        g = mix(g)[order]
        np.cumsum(g, out=total[1:])
        end = np.cumsum(count)
        value = (total[end] - total[end - count]).reshape(parts, 3)
        full = (count > 0).reshape(parts, 3)
        salt = salted(parts * 3, (instance * 64 + seed) * 1000003 + 5).reshape(parts, 3)
        pairs = ((0, 1), (0, 2), (1, 2))
        out = np.stack([mix(mix(value[:, a] + salt[:, i]) * U64(3) + value[:, b]) for i, (a, b) in enumerate(pairs)], axis=1)
        some = np.stack([full[:, a] | full[:, b] for a, b in pairs], axis=1)
        return out[some], parts < n1 or 2 * int((full.sum(axis=1) >= 2).sum()) > k

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = []
        if len(h) <= self.small:
            out.append(mix(h + U64(11)))
        if len(h) > SMALL:
            own = int(np.searchsorted(self.first, len(h), side="right")) - 1
            for instance in (own, own + 1):
                for seed in range(3):
                    signatures, enough = self.cells(h, instance, seed)
                    out.append(signatures)
                    if enough:
                        break
                else:
                    out.append(mix(h + U64(12 + instance)))
        return np.concatenate(out)


def sketch(h: np.ndarray) -> bytes | None:
    """One byte of the least hash in each of ``BINS`` bins, 0 where a bin is empty; none for sets under ``SKETCHED``."""
    if len(h) < SKETCHED:
        return None
    g = np.sort(mix(h + U64(4)))[::-1]
    out = np.zeros(BINS, np.uint8)
    out[(g & U64(BINS - 1)).astype(np.int64)] = (g >> U64(32)) % U64(255) + U64(1)  # the last written, hence the least, stays
    return out.tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node, sketch) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(h), node_of(h), sketch(h)) for h in shingle_sets(batch.column("text"), n)]
            columns = [pa.array(x, f.type) for x, f in zip(zip(*sets, strict=True), list(schema)[1:], strict=True)] if sets else [pa.array([], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    return _texts(docs).mapInArrow(lean(run), "doc_id bigint, n_shingles bigint, node bigint, sketch binary")


def node_of(h: np.ndarray) -> int:
    """The name of a set."""
    return int(mix(mix(h).sum(dtype=U64, keepdims=True) + U64(len(h))).view(np.int64)[0])


def signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, node): a row for every signature of every set, once a task."""

    def rows(parts: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        node = np.repeat(np.array([x[1] for x in parts]), [len(x[0]) for x in parts])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in parts]).view(np.int64)), pa.array(node)], names=["sig", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = Signer(percent), set()
        for batch in batches:
            parts: list[tuple[np.ndarray, int]] = []
            for h in shingle_sets(batch.column("text"), n):
                node = node_of(h)
                if len(h) and node not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(node)
                    parts.append((signer(h), node))
                if len(parts) >= 500:
                    yield rows(parts)
                    parts = []
            if parts:
                yield rows(parts)

    return _texts(docs).mapInArrow(lean(run), "sig bigint, node bigint")


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Sketches that are not null, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _alike(percent: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which sketches do not rule out the similarity: of the m bins that either has, a pair at the limit t agrees in t * m, with
    a standard deviation of at most sqrt(m * t * (1 - t)); it may fall short by ``APART`` of these."""
    t = percent / 100
    m = ((x > 0) | (y > 0)).sum(axis=1)
    return ((x == y) & (x > 0)).sum(axis=1) >= t * m - APART * np.sqrt(m * t * (1 - t))


def _plausible(percent: int):
    """Pairs but those whose sketches rule out the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            a, b = batch.column("sa"), batch.column("sb")
            both = np.flatnonzero(np.asarray(a.is_valid()) & np.asarray(b.is_valid()))
            if len(both):
                keep[both] = _alike(percent, *(_bytes_of(c.take(pa.array(both))) for c in (a, b)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, hot, cold) of different nodes from rows (sig, node) in order: the first ``FEW`` + 1 rows of a signature all meet,
    later ones meet its first. hot and cold count the signatures: the rows of one of more than ``FEW`` + 1 make hot pairs with its first,
    which is their a; pairs among its first rows count as cold too."""
    last = [np.zeros(0, np.int64)] * 2  # the last rows so far
    rank, head = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each its rank in its signature, and that one's first node
    for batch in batches:
        if not len(batch):
            continue
        s, v = (np.concatenate([a, batch.column(c).to_numpy()]) for a, c in zip(last, ("sig", "node"), strict=True))
        old = len(last[0])
        keep = np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])]
        keep[:old] = True
        s, v = s[keep], v[keep]
        at = np.arange(len(s))
        start = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))
        place, first = at - start, v[start]
        if old:  # the signature that was open when these rows began
            same = s == s[0]
            place[same] += rank[0]
            first[same] = head[0]
        new, place_ = at[old:], place[old:]
        a, b = [], []
        for lag in range(1, FEW + 1):
            i = new[(place_ >= lag) & (place_ <= FEW)]
            a.append(v[i - lag])
            b.append(v[i])
        grown = new[place_ == FEW + 1]  # with this row the signature is large: those before it count too
        early = (grown[:, None] - np.arange(1, FEW + 1)).ravel()
        hot = np.concatenate([new[place_ > FEW], early])
        a, b, warm = np.concatenate([*a, first[hot]]), np.concatenate([*b, v[hot]]), np.r_[np.zeros(sum(map(len, a)), bool), np.ones(len(hot), bool)]
        order = np.lexsort((b, a))
        a, b, warm = a[order], b[order], warm[order]
        one = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        times = np.diff(np.r_[one, len(a)])
        hots = np.add.reduceat(warm, one, dtype=np.int64) if len(one) else times
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[one], b[one], hots, times - hots)], names=["a", "b", "hot", "cold"])
        tail = slice(max(0, len(s) - FEW - 1), None)
        last, rank, head = [s[tail], v[tail]], place[tail], first[tail]


def _check(percent: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            ids = batch.column("b").to_pylist()
            ok = []
            left = shingle_sets(batch.column("text_a"), n)
            texts = batch.column("text_b")
            for i, (k, x) in enumerate(zip(ids, left, strict=True)):
                if k != last:
                    last, kept = k, next(shingle_sets(texts.slice(i, 1), n))
                both = len(np.intersect1d(x, kept, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(kept) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _plausible_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the smallest doc_ids of pairs of nodes of different components that neither their sizes nor their sketches rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("id").alias(f"i{x}"), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and ca <> cb")
        .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "sa", "sb")
        .mapInArrow(lean(_plausible(percent)), "a bigint, b bigint")
    )


def _texts_near(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in rows (a), and of those that share a bit with one, so that other texts are not shuffled."""
    table = _bit_table(ids)

    @F.arrow_udf("boolean")
    def marked(doc_id: pa.Array) -> pa.Array:
        return pa.array(_marked(table, doc_id.to_numpy(zero_copy_only=False)))

    return _texts(docs).where("doc_id is not null").where(marked("doc_id"))


def _texts_in(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in the pairs, and of few others."""
    return _texts_near(pairs.select("a").union(pairs.select("b")), docs)


def _linked(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs of doc_ids that the texts bear out."""
    texts = written(_texts_in(pairs, docs))
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = written(with_b.select("a", "b", "text_a", "text_b").sortWithinPartitions("b").mapInArrow(lean(_check(percent, n)), "a bigint, b bigint").distinct())
    discard(texts)
    return links


def _frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """How many of the texts hold an n-gram of each of the ``BUCKETS`` ranges of hashes: a fixed, small table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for h in shingle_sets(batch.column("text"), n):
                np.add.at(total, _bucket(h), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "times"])

    rows = texts.select("text").mapInArrow(lean(run), "bucket bigint, times bigint").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("times").to_numpy()
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _prefixes(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(gram, at, n, node) of the rarest n-grams of each text, so many that two similar texts share the first that they have in common."""
    times = _frequencies(texts, n)
    schema = pa.schema([("gram", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                heads, sizes, nodes = [], [], []
                for h in shingle_sets(part.column("text"), n):
                    order = np.lexsort((h, times[_bucket(h)]))
                    heads.append(h[order[: len(h) - (len(h) * percent + 99) // 100 + 1]])
                    sizes.append(len(h))
                    nodes.append(node_of(h))
                if heads:
                    many = [len(x) for x in heads]
                    columns = (np.concatenate(heads).view(np.int64), np.concatenate([np.arange(m) for m in many]), np.repeat(sizes, many), np.repeat(nodes, many))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.mapInArrow(lean(run), "gram bigint, at int, n int, node bigint")


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of their n-grams those whose n-gram is not in one row alone."""
    last, alone = None, False  # the row that was last, and whether it is the first of its n-gram
    for batch in batches:
        if not len(batch):
            continue
        gram = batch.column("gram").to_numpy()
        new = np.r_[last is None or last.column("gram")[0].as_py() != gram[0], gram[1:] != gram[:-1]]
        if last is not None and alone and not new[0]:
            yield last
        yield batch.filter(pa.array(~(new & np.r_[new[1:], True])))  # of the last row the next batch decides, if it is the first of its n-gram
        last, alone = batch.slice(len(batch) - 1), bool(new[-1])


_ROW = ("gram", "component", "at", "n", "id")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [*(batch.column(c).to_numpy().astype(np.int64) for c in _ROW), _bytes_of(batch.column("sketch"))]


def _may_be(percent: int, at: np.ndarray, n: np.ndarray, ids: np.ndarray, sketches: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows x and y their sizes, places and sketches do not rule out. A set without a sketch has only zeros there."""
    need = (percent * (n[x] + n[y]) + 99 + percent) // (100 + percent)
    ok = (np.minimum(n[x] - at[x], n[y] - at[y]) >= need) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (ids[x] != ids[y])
    left = np.flatnonzero(ok & (n[x] >= SKETCHED) & (n[y] >= SKETCHED))
    for lo in range(0, len(left), _COMPARED):
        i = left[lo : lo + _COMPARED]
        ok[i] = _alike(percent, sketches[x[i]], sketches[y[i]])
    return ok


def _pairs_once(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = np.minimum(a, b), np.maximum(a, b)
    one = np.unique(mix(a.view(U64)) * U64(3) + b.view(U64), return_index=True)[1]
    return pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one])], names=["a", "b"])


def _to_first(percent: int, many: int):
    """Pairs (a, b) of each row and the first ``many`` of its n-gram, where they are of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[np.ndarray] = []  # the first rows of the n-gram that is open
        for batch in batches:
            if not len(batch):
                continue
            rows = _columns(batch)
            gram, component, at, n, ids, sketches = [np.concatenate(x) for x in zip(head, rows, strict=True)] if head else rows
            i = np.arange(len(gram))
            first = np.maximum.accumulate(np.where(np.r_[True, gram[1:] != gram[:-1]], i, 0))
            new = i[len(head[0]) :] if head else i
            a, b = [], []
            for k in range(many):
                y = new[first[new] + k < new]
                y = y[component[first[y] + k] != component[y]]
                y = y[_may_be(percent, at, n, ids, sketches, first[y] + k, y)]
                a.append(ids[first[y] + k])
                b.append(ids[y])
            yield _pairs_once(np.concatenate(a), np.concatenate(b))
            last = slice(int(first[-1]), int(first[-1]) + many)
            head = [x[last] for x in (gram, component, at, n, ids, sketches)]

    return run


def _across(percent: int):
    """Pairs (a, b) of ids of different components from rows in the order of n-gram and component, but those that ``_may_be`` rules out."""

    def pairs(gram: np.ndarray, component: np.ndarray, at: np.ndarray, n: np.ndarray, ids: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
        i = np.arange(len(gram))
        new = np.r_[True, gram[1:] != gram[:-1]]
        start = np.maximum.accumulate(np.where(new, i, 0))
        own = np.maximum.accumulate(np.where(new | np.r_[True, component[1:] != component[:-1]], i, 0))
        many = own - start  # each row meets the rows of its n-gram before those of its component
        done = np.cumsum(many)
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + _PAIRS, side="right")))
            m = many[lo:hi]
            y = np.repeat(i[lo:hi], m)
            x = start[y] + np.arange(len(y)) - np.repeat(np.cumsum(m) - m, m)
            ok = _may_be(percent, at, n, ids, sketches, x, y)
            if ok.any():
                yield _pairs_once(ids[x[ok]], ids[y[ok]])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            rows = _columns(batch)
            ends = np.flatnonzero(rows[0] != rows[0][-1])  # the n-gram of the last row may go on
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if held and (cut or held[-1][0][-1] != rows[0][0]):
                yield from pairs(*(np.concatenate(c) for c in zip(*held, [r[:cut] for r in rows], strict=True)))
                held = []
            elif cut:
                yield from pairs(*(r[:cut] for r in rows))
            held.append([r[cut:] for r in rows])
        if held:
            yield from pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, least, most): of each first node the least and the greatest component among the rows (firsts, component) of a batch."""
    for batch in batches:
        firsts = batch.column("firsts")
        a, c = firsts.flatten().to_numpy(), np.repeat(batch.column("component").to_numpy(), firsts.value_lengths().to_numpy())
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        new = np.r_[True, a[1:] != a[:-1]][: len(a)]
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(c[new]), pa.array(c[np.r_[new[1:], True][: len(a)]])], names=["a", "least", "most"])


def _bit(a: np.ndarray) -> np.ndarray:
    return (mix(a.view(U64)) % U64(FIRSTS)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = _bit(batch.column("a").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((U64(1) << (bit & 63).astype(U64)).view(np.int64))], names=["word", "bits"])


def _bit_table(ids: DataFrame) -> np.ndarray:
    """The ``FIRSTS`` bits of all a of rows (a): a table of fixed size."""
    words = ids.mapInArrow(lean(_bits), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FIRSTS // 64, U64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    return table


def _marked(table: np.ndarray, a: np.ndarray) -> np.ndarray:
    bit = _bit(a)
    return (table[bit >> 6] >> (bit & 63).astype(U64)) & U64(1) > 0


def _mixed(hot: DataFrame, named: DataFrame) -> DataFrame:
    """(node, id, component) of the nodes of large signatures that more than one class has, or whose first has another such signature.

    A node's firsts are held as one array (no more than it has signatures), so their pairs are not expanded. Firsts of several classes mark
    bits in a table of fixed size; a node with a marked first is taken, also one whose first shares a bit with another, which costs
    work in the exact join and changes no result."""
    own = hot.select(F.col("a").alias("b"), "a").distinct()
    held = hot.select("b", "a").union(own).groupBy(F.col("b").alias("node")).agg(F.collect_set("a").alias("firsts"))
    held = written(held.join(named.where("component is not null"), "node"))
    stars = held.select("firsts", "component").mapInArrow(lean(_stars), "a bigint, least bigint, most bigint")
    mixed = stars.groupBy("a").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most")
    table = _bit_table(mixed.select("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = batch.column("firsts")
            keep = np.zeros(len(batch), bool)
            keep[np.repeat(np.arange(len(batch)), firsts.value_lengths().to_numpy())[_marked(table, firsts.flatten().to_numpy())]] = True
            yield batch.select(["node", "id", "component"]).filter(pa.array(keep))

    return held.mapInArrow(lean(run), "node bigint, id bigint, component bigint")


def _texts_of(some: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text), once, of the nodes' smallest documents. Other texts of such a doc_id come too, and change no result."""
    ids = some.select(F.col("id").alias("doc_id"))
    texts = _texts_near(ids.toDF("a"), docs).join(ids, "doc_id", "left_semi").withColumn("version", F.xxhash64("text"))
    return written(texts.dropDuplicates(["doc_id", "version"]).select("doc_id", "text"))


def _shared(grams: DataFrame) -> DataFrame:
    """The rows of n-grams that more than one row has; most of the rarest are in one only."""
    return grams.repartition("gram").sortWithinPartitions("gram").mapInArrow(lean(_of_several), grams.schema)


def _of_classes(grams: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of n-grams that more than one class has, and how many rows the n-gram has. Classes are only ever joined, so the others
    never make a pair of different ones."""
    alike = Window.partitionBy("gram")
    found = grams.join(named.where("id is not null").select("node", "component"), "node")
    ends = found.select(*grams.columns, *(f("component").over(alike).alias(x) for f, x in ((F.min, "least"), (F.max, "most"), (F.count, "rows"))))
    return ends.where("least <> most").drop("least", "most")


def _dealt(grams: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of each n-gram together, those of the largest component first."""
    size = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sketches = nodes.select("node", F.coalesce("sketch", F.lit(bytes(BINS))).alias("sketch"))
    rows = grams.join(named.where("id is not null").join(size, "component").join(sketches, "node").select("node", "id", "component", "size", "sketch"), "node").withColumn("turn", F.xxhash64("gram", "node"))
    return rows.repartition("gram").sortWithinPartitions("gram", F.desc("size"), "component", "turn").select(*_ROW, "sketch")


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_shingles, component_id) of every row, (a, b) links between the smallest doc_ids of equal sets, as many as the classes need and some more)."""
    rows = written(described(docs, n))
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
    nodes = written(nodes)

    def classes(links: DataFrame, named: DataFrame) -> DataFrame:
        """``named`` with the classes that links join made one; many links between two classes are one edge."""
        of = lambda x: named.where("id is not null").select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        joined = components(links.join(of("a"), "a").join(of("b"), "b").select("ca", "cb").distinct(), "ca", "cb")
        found = named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
        return written(found.select("node", "id", F.coalesce("whole", "component").alias("component")))

    met = signed(docs, n, percent).repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(lean(_meet), "a bigint, b bigint, hot bigint, cold bigint")
    met = written(met.groupBy("a", "b").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold")))
    best = lambda times: met.where(f"{times} > 0").groupBy("b").agg(F.max(F.struct(times, "a")).alias("x")).select("x.a", "b")
    each = nodes.withColumn("component", F.col("id"))
    tried = written(_plausible_pairs(best("cold").union(best("hot")).distinct(), each, percent))
    checked, links = [tried], _linked(tried, docs, n, percent)
    named = classes(links, each.select("node", "id", "component"))

    def settle(more: DataFrame, texts: DataFrame) -> None:
        """Checks those of the pairs that were not, and forms the classes anew."""
        nonlocal tried, links, named
        more = written(more.join(tried, ["a", "b"], "left_anti"))
        checked.append(more)
        fresh = _linked(more, texts, n, percent)
        if not fresh.isEmpty():
            tried, links = tried.union(more), links.union(fresh)
            named = classes(fresh, named)

    settle(_plausible_pairs(met.where("cold > 0").select("a", "b"), nodes.join(named.select("node", "component"), "node"), percent), docs)
    texts = _texts_of(_mixed(met.where("hot > 0").select("a", "b"), named), docs)
    grams = written(_of_classes(_shared(_prefixes(texts, n, percent)), named))
    discard(met)
    settled = 0  # all rows of an n-gram of so many have met
    for k in (*FIRST, 0):
        meet = _to_first(percent, k) if k else _across(percent)
        settle(_dealt(grams.where(f"rows > {settled}"), named, nodes).mapInArrow(lean(meet), "a bigint, b bigint").distinct(), texts)
        settled = k + 1
    discard(grams, texts, *checked)
    out = rows.join(named.select("node", "component"), "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")), links


def op1_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return similar_classes(docs)[0]


def keep_one_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each class of near duplicates, and every row without a doc_id."""
    classes = similar_classes(docs, n, percent)[0]
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(first, "doc_id", "left_semi").select(*map(named, docs.columns)).union(docs.where("doc_id is null"))


#: All pairs that share a shingle, and for each document the smallest id that links lead to.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT a, a FROM both_ways UNION SELECT x.b, r.c FROM r JOIN both_ways x ON x.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
