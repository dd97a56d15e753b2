"""Importance resampling and ranked lexical search."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import duck_rows

from granary.llm import importance, lexical, queries


def plain_words(text, breaks):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(breaks, low)


def plain_draw(docs, target, p):
    def feats(text):
        w = plain_words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % p.buckets for n in range(1, p.grams + 1) for i in range(len(w) - n + 1)]

    each = [(d, *feats(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in feats(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + p.buckets) / ((s[b] + 1) * (tt + p.buckets)))) for b in range(p.buckets)]
    rows = []
    for d, n, f in each:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{p.key}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, n, len(f), weight, score))
    may = sorted((r for r in rows if r[0] is not None and r[1] >= p.least_words), key=lambda r: (-r[4], r[0]))
    ranks = list(range(1, p.percent * len(may) // 100 + 1)) + [None] * len(may)
    rest = [(*r, None) for r in rows if r[0] is None or r[1] < p.least_words]
    return sorted(map(repr, [*((*r, k) for r, k in zip(may, ranks)), *rest]))


@pytest.mark.parametrize("p", [importance.Params(), importance.Params(grams=3, buckets=97, least_words=3, percent=40, key="k")])
def test_draw_equals_plain(spark, odd_docs, p):
    rnd = random.Random(4)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(100 + i, " ".join(rnd.choice(["Ab", "c9", "ß", "漢", "x-y", "the"]) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    target = ["the c9 c9 the", None, "", "Ab x y; the"]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    out = importance.drawn(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), p)
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain_draw(rows, target, p)


def test_draw_of_nothing(spark, no_docs, odd_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert importance.op12_importance(no_docs, items).count() == 0
    assert importance.op12_importance(odd_docs, items).count() == odd_docs.count()
    kept = importance.resample(odd_docs, items, importance.Params(percent=100, least_words=1))
    assert kept.columns == odd_docs.columns and kept.where("doc_id is null or text is null").count() == 0 and kept.where("doc_id = 2").count() == 2


def test_spans_overlap():
    got = [m.span() for m in importance.scanner(2).finditer(b"a bb c a", overlapped=True)]
    assert got == [(0, 4), (2, 6), (5, 8)]
    assert importance.collapsed("--A\n\tb..é".encode()) == "a b é".encode()


def plain_search(docs, items, k=10):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    held = [(d, Counter(w), len(w)) for d, t in docs if d is not None and (w := plain_words(t, pattern))]
    n, length, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for i, text in items:
        q = Counter(plain_words(text, pattern))
        scored = []
        for d, c, long in held:
            m = 25 + (75 * long * n) // length
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in q.items() if c[t])
            scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("p", [lexical.Params(), lexical.Params(k=3, query_bytes=40, postings=20)])
def test_search_equals_plain(spark, odd_docs, p):
    rnd = random.Random(9)
    vocabulary = [f"W{i}" for i in range(30)] + ["é", "漢字", "under_score"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rnd.choices(vocabulary, weights, k=n))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(100 + i, text(rnd.randint(0, 80))) for i in range(200)]
    items = [(i, text(rnd.randint(1, 12))) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere at all"), (None, "w1 w20"), (7, "w0 w0 w0 w29"), (53, "one two eleven short")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int").repartition(5)
    out = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), p)
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain_search(rows, items, p.k)


def test_few_accumulators_in_later_blocks():
    """Common terms of documents that can no longer come in are not looked at: their postings stay without an accumulator."""
    q = lexical.parsed([(0, "rare common")])
    rare, common = (int(np.searchsorted(q.hashes, lexical.parsed([(0, w)]).hashes[0])) for w in ("rare", "common"))
    weight, df = np.zeros(2, np.int64), np.zeros(2, np.int64)
    weight[[rare, common]], df[[rare, common]] = (9000, 10), (10, 5000)
    s = lexical.Search(q, weight, df, 10)
    for block in range(5):
        ids = np.arange(1000) + 1000 * block
        term, doc = np.concatenate([np.full(10, rare), np.full(1000, common)]), np.concatenate([np.arange(10), np.arange(1000)])
        s.add(ids, 1000, doc, term, np.ones(1010, np.int64), np.full(1000, 100))
    scores, docs = s.best[0]
    assert docs.tolist() == list(range(10)) and len(set(scores.tolist())) == 1


def test_search_of_nothing(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    assert lexical.op13_lexical(no_docs, some).count() == 0 and lexical.op13_lexical(odd_docs, none).count() == 0
    assert lexical.op13_lexical(odd_docs, some).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("name", ["op12_importance", "op13_lexical"])
def test_oracle_on_odd_rows(name, spark, odd_docs, tmp_path):
    """SQL and query agree on nulls, ties and repeated rows as well."""
    import duckdb

    rows = odd_docs.where("doc_id is not null").distinct()
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one SIX six ten"), (2, None), (3, "w5x5 é short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    from helpers import rows_of

    assert rows_of(queries.queries()[name](spark, str(tmp_path))) == duck_rows(c, queries.oracle_sql()[name])
