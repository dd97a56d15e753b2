"""Approximate nearest neighbours: a neighbour graph by NN-descent, and queries by greedy search on it.

Equal vectors are one node, so copies cost nothing and cannot crowd a neighbour list; a node keeps its smallest ids.

The graph starts from a few random orders: nodes sorted by the signs of random projections are read in runs, and each
takes the nearest of its run. Then it descends: neighbours of a node, in both directions, are likely to be neighbours
of each other. Every round, members of each node's list (its newest, and a sample of those it is a neighbour of) come
together with their vectors in half precision, and pairs nearer than what either knows are proposed; a grouped top-k takes
them in. Rounds are written tables, and end when few lists change.

A search keeps a pool of the nearest nodes found. Each round expands the nearest not yet expanded: their neighbours are joined
to the vectors, measured in double precision on the original values, and merged. All queries go on together.

Defined results: vectors that are null, of another length than most, zero, or hold nulls or values that are not finite take no part.
Ties go to the smaller id. Fewer candidates than ``k`` give them all. Repeated ids are taken once, with one of their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, written


@dataclass(frozen=True)
class Params:
    degree: int = 32  # neighbours kept of each node
    sample: int = 18  # of each direction that meet in a round
    orders: int = 3  # random orders to start from
    run: int = 64  # nodes that are compared in an order
    rounds: int = 7
    settled: float = 0.02  # share of changed neighbours at which rounds end
    pool: int = 240  # nodes a search keeps
    expand: int = 40  # nodes a search expands in a round
    searches: int = 7  # rounds of a search
    seed: int = 5


def nodes_of(vectors: DataFrame, id_: str, vector: str, most: int) -> DataFrame:
    """(node, vec, ids): one row for each distinct usable vector: its smallest id and at most ``most`` of its smallest."""
    v = F.col("v")
    some = vectors.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    some = some.where(ok).groupBy("id").agg(F.min("v").alias("v"))
    some = written(some)
    length = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    some = some.join(F.broadcast(length), F.size("v") == F.col("n")).select("id", "v")  # one row
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = some.withColumn("rank", rank).where(F.col("rank") <= most)
    return written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), F.col("v").alias("vec"), "ids"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in half precision; values beyond its range are clipped, which only the graph sees."""
    for b in batches:
        v = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        v = np.clip(v, -3e4, 3e4)
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())], names=["node", "half"])


def _codes(seed: int, orders: int):
    """(turn, code, node, half): the signs of 48 random projections, for each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("half"), np.float16)
            for turn in range(orders):
                flat = np.random.default_rng(seed * 100 + turn).normal(size=(v.shape[1], 48)).astype(np.float32)
                code = ((v @ flat) > 0).astype(np.int64) @ (1 << np.arange(47, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), turn, np.int32)), pa.array(code), b.column("node"), b.column("half")], names=["turn", "code", "node", "half"])

    return run


def _nearest_in_run(size: int, keep: int):
    """(node, near, dist) among every ``size`` consecutive rows of one turn."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        v, node, turn = _matrix(rows.column("half").combine_chunks(), np.float16), rows.column("node").to_numpy(), rows.column("turn").to_numpy()
        for t in np.unique(turn):
            of = np.flatnonzero(turn == t)
            for at in range(0, len(of), size):
                pick = of[at : at + size]
                x, n = v[pick], node[pick]
                d = _squares(x, x)
                np.fill_diagonal(d, np.inf)
                k = min(keep, len(n) - 1)
                if k <= 0:
                    continue
                best = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(n, k)), pa.array(n[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel())], names=["node", "near", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            kept.append(b)
            n = sum(map(len, kept))
            if n >= 8192:
                table = pa.Table.from_batches(kept)
                full = n - n % size
                yield from solve(table.slice(0, full))
                kept = table.slice(full).to_batches()
        if kept:
            yield from solve(pa.Table.from_batches(kept))

    return run


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)


def _top(keep: int):
    """The ``keep`` nearest of each node, from rows (node, dist, near, age) in order; age 0 is older and wins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node0, count0, last0 = None, 0, None
        for b in batches:
            node, near = b.column("node").to_numpy(), b.column("near").to_numpy()
            if not len(node):
                continue
            same = np.r_[node[0] == node0 if node0 is not None else False, node[1:] == node[:-1]]
            again = same & np.r_[near[0] == last0 if last0 is not None else False, near[1:] == near[:-1]]
            step = (~again).astype(np.int64)
            total = np.cumsum(step)
            first = np.flatnonzero(~same)
            base = np.zeros(len(node), np.int64)
            if len(first):
                base[first] = total[first] - step[first]
            base = np.maximum.accumulate(base)
            rank = total - base
            rank[: first[0] if len(first) else len(node)] += count0
            keep_ = (rank <= keep) & ~again
            yield b.select(["node", "near", "dist", "age"]).filter(pa.array(keep_))
            node0, count0, last0 = node[-1], int(rank[-1]), near[-1]

    return run


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals (node, near, dist) between the members of each list, from rows (centre, near, fresh, radius, half) sorted by centre."""

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        near, fresh, radius = rows.column("near").to_numpy(), rows.column("fresh").to_numpy(zero_copy_only=False), rows.column("radius").to_numpy()
        near, pick = np.unique(near, return_index=True)
        if len(near) < 2:
            return None
        v, fresh, radius = _matrix(rows.column("half"), np.float16)[pick], fresh[pick], radius[pick]
        d = _squares(v, v)
        good = (d < radius[:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(good, False)
        a, b = np.nonzero(good)
        return pa.RecordBatch.from_arrays([pa.array(near[a]), pa.array(near[b]), pa.array(d[a, b])], names=["node", "near", "dist"]) if len(a) else None

    rest: pa.RecordBatch | None = None
    for b in batches:
        b = pa.concat_batches([rest, b]) if rest is not None else b
        centre = b.column("centre").to_numpy()
        cut = np.r_[0, np.flatnonzero(centre[1:] != centre[:-1]) + 1] if len(centre) else np.zeros(0, np.int64)
        found = [x for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if (x := solve(b.slice(lo, hi - lo))) is not None]
        if found:
            yield pa.concat_batches(found)
        rest = b.slice(int(cut[-1])) if len(cut) else b
    if rest is not None and len(rest) and (x := solve(rest)) is not None:
        yield x


def _merged(rows: DataFrame, keep: int) -> DataFrame:
    """(node, near, dist, age): the ``keep`` nearest of each node."""
    return rows.repartition("node").sortWithinPartitions("node", "dist", "near", "age").mapInArrow(_top(keep), "node bigint, near bigint, dist float, age int")


def neighbour_graph(nodes: DataFrame, p: Params = Params()) -> DataFrame:
    """(node, near, dist, age): about the ``degree`` nearest of every node."""
    v = nodes.select("node", F.col("vec").cast("array<double>").alias("vec"))
    halves = written(v.mapInArrow(_halves, "node bigint, half binary"))
    runs = halves.mapInArrow(_codes(p.seed, p.orders), "turn int, code bigint, node bigint, half binary")
    first = runs.repartitionByRange("turn", "code", "node").sortWithinPartitions("turn", "code", "node").mapInArrow(_nearest_in_run(p.run, p.degree), "node bigint, near bigint, dist float")
    graph = kept = written(_merged(first.withColumn("age", F.lit(1)), p.degree))
    for turn in range(p.rounds):
        radius = graph.groupBy("node").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n")).select(F.col("node").alias("near"), F.when(F.col("n") < p.degree, float("inf")).otherwise(F.col("far")).cast("float").alias("radius"))
        out = graph.select(F.col("node").alias("centre"), "near", (F.col("age") == 1).alias("fresh"))
        back = graph.select(F.col("near").alias("centre"), F.col("node").alias("near"), (F.col("age") == 1).alias("fresh"))
        order = F.xxhash64(F.lit(turn), "centre", "near")
        rank = F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("fresh"), order))
        members = out.withColumn("rank", rank).where(F.col("rank") <= p.sample).union(back.withColumn("rank", rank).where(F.col("rank") <= p.sample)).drop("rank")
        known = halves.select(F.col("node").alias("near"), "half").join(radius, "near", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf")).cast("float")))
        meet = members.join(known, "near").select("centre", "near", "fresh", "radius", "half")
        proposals = meet.repartition("centre").sortWithinPartitions("centre").mapInArrow(_local_join, "node bigint, near bigint, dist float")
        # members that met are old from now on; what has not met stays fresh
        met = members.where("fresh").select(F.col("centre").alias("node"), "near").distinct().withColumn("met", F.lit(True))
        old = graph.join(met, ["node", "near"], "left").select("node", "near", "dist", F.when(F.col("met"), 0).otherwise(F.col("age")).alias("age"))
        pairs = old.union(proposals.withColumn("age", F.lit(2)))
        merged = written(_merged(pairs, p.degree))
        discard(kept)
        kept, changed = merged, merged.where("age = 2").count()
        graph = merged.withColumn("age", F.least("age", F.lit(1)))
        if changed <= p.settled * max(1, merged.count()):
            break
    discard(halves)
    return graph


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, node, score): exact Euclidean distances in double precision."""
    for b in batches:
        if not len(b):
            continue
        x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for c in ("qvec", "vec"))
        yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(np.sqrt(((x - y) ** 2).sum(axis=1)))], names=["query", "node", "score"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, k: int, p: Params = Params()) -> DataFrame:
    """(query, node, score): the pool of each query of (query, start, qvec); start is the node to begin at."""
    both = graph.select("node", "near", F.lit(0).alias("reverse")).union(graph.select(F.col("near").alias("node"), F.col("node").alias("near"), F.lit(1).alias("reverse")))
    both = both.groupBy("node", "near").agg(F.min("reverse").alias("reverse"))  # a node's own neighbours are kept, those it is a neighbour of are thinned
    lists = both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("reverse", F.xxhash64("near")))).where(F.col("rank") <= 3 * p.degree)
    lists = written(lists.groupBy("node").agg(F.collect_list("near").alias("near")))
    vec = nodes.select("node", F.col("vec").cast("array<double>").alias("vec"))
    entries = nodes.select("node").orderBy(F.xxhash64(F.lit(p.seed), "node")).limit(8)

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(vec, "node").join(queries.select("query", "qvec"), "query").select("query", "node", "qvec", "vec")
        return rows.mapInArrow(_distances, "query bigint, node bigint, score double")

    first = queries.select("query", F.col("start").alias("node")).union(queries.select("query").crossJoin(F.broadcast(entries))).distinct()  # 8 rows
    pool = written(measured(first).withColumn("open", F.lit(True)))
    for _ in range(p.searches):
        turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("open"), "score", "node"))
        ranked = pool.withColumn("next", F.col("open") & (turn <= p.expand))
        ranked = written(ranked)
        discard(pool)
        found = ranked.where("next").join(lists, "node").select("query", F.explode("near").alias("node")).distinct()
        fresh = found.join(ranked.select("query", "node"), ["query", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "node"))
        rows = ranked.select("query", "node", "score", (F.col("open") & ~F.col("next")).alias("open")).union(measured(fresh).withColumn("open", F.lit(True)))
        pool = written(rows.withColumn("rank", rank).where(F.col("rank") <= p.pool).drop("rank"))
        discard(ranked)
        if pool.where("open").isEmpty():
            break
    discard(lists)
    return pool.select("query", "node", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding", p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row where ``is_query`` (a condition on the id) holds."""
    nodes = nodes_of(vectors, id_, vector, k + 1)
    asked = vectors.where(is_query).select(F.col(id_).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("qvec")).where("query is not null and qvec is not null")
    asked = written(asked.groupBy("query").agg(F.min("qvec").alias("qvec")).join(nodes.select(F.col("node").alias("start"), F.col("vec").alias("qvec")), "qvec").select("query", "start", "qvec"))
    pool = search(nodes, neighbour_graph(nodes, p), asked, k, p)
    rows = pool.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def op3_nn_descent(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 100 == 0)
