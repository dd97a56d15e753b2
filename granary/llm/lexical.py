"""Ranked lexical search: whole-number BM25 scores of all documents for a set of queries, ten (or k) best each.

Documents are held in blocks and every query is worked off against a block term at a time, rarest term first, with limited accumulators: a
document gets one only while the terms still to come could lift it to the kth partial score. Once their bounds sum to less, no
further accumulators are made, and those that can still reach it are brought up to date exactly. The kth score that a task has
reached is kept from block to block, so later blocks make few accumulators. Nothing is lost by it: the result is that of scoring all.

The texts are read once, into a written table of the queries' terms in each document (numbers of terms and occurrences); collection statistics
and the search read that table. No text is shuffled; a task sends k rows a query to the last ranking. Queries are taken from their table in blocks of
``Params.query_bytes``, so what is held of them is bounded; each further block reads the documents again.

Terms are runs of letters, digits and bytes of longer characters, A-Z folded; they meet as 64-bit hashes that also cover their length (two different
terms fall together with a chance in the order of pairs / 2**64).

Defined results: documents without a doc_id take no part, neither do those without terms. Repeated rows are documents of their own, ranked in
any order if equal in doc_id and score. Each row of the queries is a query of its own, also without an id; without terms, or where nothing scores above 0, it has no
rows. Empty tables give an empty result. Further columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .textkit import blocks, words

_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False


@dataclass(frozen=True)
class Params:
    """``query_bytes`` bounds the query texts, and ``postings`` the postings, that are held at a time."""

    k: int = 10
    query_bytes: int = 8 << 20
    postings: int = 1 << 20


@dataclass(frozen=True)
class Queries:
    """A block of queries: sorted hashes of their terms, and of query i the terms ``term[at[i]:at[i + 1]]`` with their repeats."""

    ids: list
    hashes: np.ndarray
    at: np.ndarray
    term: np.ndarray
    repeats: np.ndarray


def parsed(rows: list[tuple[object, str | None]]) -> Queries:
    h, owner = [], []
    for row, data, starts in blocks(pa.array([t for _, t in rows], pa.string())):
        found, _, _, at = words(data, starts, _BREAKS)
        h.append(found)
        owner.append(np.repeat(np.arange(row, row + len(starts) - 1), np.diff(at)))
    hashes, term = np.unique(np.concatenate([*h, np.zeros(0, np.uint64)]), return_inverse=True)
    pairs, repeats = np.unique(np.concatenate([*owner, np.zeros(0, np.int64)]) * max(len(hashes), 1) + term, return_counts=True)
    query, term = np.divmod(pairs, max(len(hashes), 1))
    return Queries([i for i, _ in rows], hashes, np.searchsorted(query, np.arange(len(rows) + 1)), term, repeats.astype(np.int64))


def query_blocks(items: DataFrame, p: Params) -> Iterator[Queries]:
    """The queries in blocks of so many bytes; a partition of them comes to the driver at a time."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        if rows and size + len(r[1] or "") > p.query_bytes:
            yield parsed(rows)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += 4 * len(r[1] or "")
    if rows:
        yield parsed(rows)


def postings(docs: DataFrame, hashes: np.ndarray, kind: str) -> DataFrame:
    """(doc_id, n, term, tf): all terms of a document with repeats, and the queries' terms in it with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(hashes), 1)
        for b in batches:
            for row, data, starts in blocks(b.column(1)):
                h, _, _, at = words(data, starts, _BREAKS)
                n = np.diff(at)
                near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                known = hashes[near] == h if len(hashes) else np.zeros(len(h), bool)
                pairs, tf = np.unique((np.repeat(np.arange(len(n)), n)[known]) * size + near[known], return_counts=True)
                doc, term = np.divmod(pairs, size)
                ends = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, of)) for x, of in ((term, pa.int32()), (tf, pa.int64()))]
                out = pa.RecordBatch.from_arrays([b.column(0).slice(row, len(n)), pa.array(n), *lists], names=["doc_id", "n", "term", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, term array<int>, tf array<bigint>")


def frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; a task sends a row a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in found.select("term").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Search:
    """The k best of all blocks given so far, for every query of a block of queries."""

    def __init__(self, queries: Queries, weight: np.ndarray, df: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)  # scores, doc_ids
        self.weight, self.order = weight, []
        for a, b in zip(queries.at[:-1], queries.at[1:], strict=True):
            self.order.append(a + np.lexsort((queries.term[a:b], df[queries.term[a:b]])))  # rarest first

    def add(self, ids: np.ndarray, n_docs: int, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        """A block of documents: their postings (doc, term, tf) in any order, doc counting from 0, and m of each document."""
        by_term = np.argsort(term, kind="stable")
        doc, term, tf = doc[by_term], term[by_term], tf[by_term]
        worth = self.weight[term] * ((10**9 * tf) // (1000 * tf + 8 * m[doc]))
        starts = np.searchsorted(term, np.arange(len(self.weight) + 1))
        bound, some = np.zeros(len(self.weight), np.int64), np.flatnonzero(np.diff(starts))
        if len(some) == 0:
            return
        bound[some] = np.maximum.reduceat(worth, starts[some])
        partial = np.zeros(n_docs, np.int64)
        for query, order in enumerate(self.order):
            terms, repeats = self.q.term[order], self.q.repeats[order]
            rest = np.append(np.cumsum((bound[terms] * repeats)[::-1])[::-1], 0)  # at i: what terms from i on can add
            self._answer(query, ids, partial, [(doc[starts[t] : starts[t + 1]], worth[starts[t] : starts[t + 1]] * r) for t, r in zip(terms, repeats, strict=True)], rest)

    def _answer(self, query: int, ids: np.ndarray, partial: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray) -> None:
        scores, docs = self.best[query]
        least = max(1, int(scores[-1])) if len(scores) == self.k else 1  # a document below it is not among the k best
        if rest[0] < least:
            return
        partial[:] = 0
        i = 0
        while i < len(lists) and rest[i] >= least:  # a document first met now could still reach the kth partial score
            partial[lists[i][0]] += lists[i][1]
            i += 1
            if i < len(lists) and len(partial) >= self.k and rest[i] < partial.max():
                least = max(least, int(np.partition(partial, -self.k)[-self.k]))
        alive = np.flatnonzero(partial + rest[i] * (partial > 0) >= least)
        for at, worth in lists[i:]:  # no new accumulators: those that live are brought up to date
            if len(at) and len(alive):
                place = np.minimum(np.searchsorted(at, alive), len(at) - 1)
                hit = at[place] == alive
                partial[alive[hit]] += worth[place[hit]]
        alive = alive[partial[alive] >= least]
        if len(alive) > self.k:
            alive = alive[partial[alive] >= np.partition(partial[alive], -self.k)[-self.k]]
        scores, docs = np.concatenate([scores, partial[alive]]), np.concatenate([docs, ids[alive]])
        first = np.lexsort((docs, -scores))[: self.k]
        self.best[query] = scores[first], docs[first]


def _best(found: DataFrame, q: Queries, weight: np.ndarray, df: np.ndarray, n: int, length: int, p: Params, kind: str) -> DataFrame:
    """(query, doc_id, score): the k best of each task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(q, weight, df, p.k)
        for b in batches:
            ends = np.append(0, np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False)))
            ids, long = b.column(0).to_numpy(), b.column(1).to_numpy()
            term, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            a = 0
            while a < len(ids):
                e = max(a + 1, int(np.searchsorted(ends, ends[a] + p.postings, "right")) - 1)
                part = slice(ends[a], ends[e])
                search.add(ids[a:e], e - a, np.repeat(np.arange(e - a), np.diff(ends[a : e + 1])), term[part], tf[part], 25 + (75 * long[a:e] * n) // length)
                a = e
        number = np.repeat(np.arange(len(q.ids)), [len(s) for s, _ in search.best])
        if len(number):
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *(pa.array(np.concatenate([x[i] for x in search.best])) for i in (1, 0))], names=["query", "doc_id", "score"])

    return found.mapInArrow(run, f"query int, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, p: Params = Params(), doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by ascending doc_id."""
    spark, kind, item_kind = docs.sparkSession, "bigint", items.schema[item].dataType.simpleString()
    texts = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast(kind).alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for q in query_blocks(items.select(item, item_text), p):
        found = written(postings(texts, q.hashes, kind))
        n, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n:
            continue
        df = frequencies(found, len(q.hashes))
        weight = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
        best = _best(found, q, weight, df, n, length, p, kind)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id")))
        names = spark.createDataFrame([(i, x) for i, x in enumerate(q.ids)], f"query int, `{item}` {item_kind}")
        best = best.withColumn("rank", place).where(F.col("rank") <= p.k)
        parts.append(best.join(F.broadcast(names), "query").select(item, "rank", "doc_id", "score"))  # a row a query of the block
    if not parts:
        return spark.createDataFrame([], f"`{item}` {item_kind}, rank int, doc_id {kind}, score bigint")
    return reduce(DataFrame.unionByName, parts)


def op13_lexical(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(documents, benchmark)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL), i AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
p AS (SELECT r, unnest({_TERMS}) AS w FROM d), tf AS (SELECT r, w, count(*) AS tf FROM p GROUP BY ALL), len AS (SELECT r, count(*) AS n FROM p GROUP BY 1),
tot AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM len), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
wt AS (SELECT w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS wt FROM df, tot),
qt AS (SELECT q, w, count(*) AS k FROM (SELECT q, unnest({_TERMS}) AS w FROM i) GROUP BY ALL),
s AS (SELECT q, r, sum(k * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM qt JOIN wt USING (w) JOIN tf USING (w) JOIN len USING (r), tot GROUP BY ALL),
x AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM x JOIN i USING (q) WHERE rank <= 10"""
