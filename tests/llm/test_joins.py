"""N-gram join, decontamination and nearest neighbours against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import ann, decontam, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: (len(s), root(d)) for d, s in sets}


def families(seed, n):
    """Texts with copies that differ by a few words, of many sizes."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        words = [f"v{rnd.randint(0, 400)}" for _ in range(rnd.choice([1, 3, 5, 6, 8, 12, 20, 24, 40, 90, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 4])):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randint(0, 9999)}"
            out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(seed, spark):
    docs = families(seed, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_jaccard(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_join_of_one_large_family(spark):
    """Hundreds of near copies of one text, more than a signature's rows all meet, are one class."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(300):
        copy = list(base)
        for _ in range(2):
            copy[rnd.randrange(200)] = f"e{rnd.randint(0, 10**6)}"
        docs.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_jaccard(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_edges_of_a_family_grow_with_its_texts(spark, monkeypatch):
    """Components of a family are formed over some edges a text, not over all pairs that met; the classes are those of brute force."""
    rnd, edges, real = random.Random(100), [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda links, a, b: (edges.append(links.count()), real(links, a, b))[1])
    docs = []
    for i in range(100):
        copy = [f"b{j}" for j in range(60)]
        copy[rnd.randrange(60)] = f"e{rnd.randint(0, 10**6)}"
        docs.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_jaccard(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert sum(edges) < 300


def test_only_texts_of_pairs_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(None, "text")], "doc_id long, text string")
    found = {r.doc_id for r in ngram_join._texts_in(spark.createDataFrame([(1, 5), (5, 1700)], "a long, b long"), docs).collect()}
    assert {1, 5, 1700} <= found and len(found) < 10


def shuffled(spark, run):
    """Rows that the stages of run() shuffle while no join is broadcast."""
    sc, key = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    before, group = spark.conf.get(key), f"shuffled-{random.random()}"
    spark.conf.set(key, -1)
    sc.setLocalProperty("spark.jobGroup.id", group)
    try:
        run()
    finally:
        spark.conf.set(key, before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_only_texts_of_mixed_nodes_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(None, "text"), (5, "text 5"), (5, "another")], "doc_id long, text string")
    some = spark.createDataFrame([(101, 1, 1), (105, 5, 5), (1700, 1700, 5)], "node long, id long, component long")
    found = []
    assert shuffled(spark, lambda: found.extend(ngram_join._texts_of(some, docs).collect())) < 100
    assert sorted((r.doc_id, r.text) for r in found) == [(1, "text 1"), (5, "another"), (5, "text 5"), (1700, "text 1700")]


def test_ngrams_of_one_class_are_left_out(spark):
    grams = spark.createDataFrame([(7, 10), (7, 11), (8, 10), (8, 12), (8, 13), (9, 12), (9, 14)], "gram long, node long")
    named = spark.createDataFrame([(10, 1, 1), (11, 2, 1), (12, 3, 3), (13, 4, 3), (14, None, None)], "node long, id long, component long")
    assert sorted(tuple(r) for r in ngram_join._of_classes(grams, named).collect()) == [(8, 10, 3), (8, 12, 3), (8, 13, 3)]


def test_all_rows_of_a_small_ngram_meet_in_the_first_pass():
    rnd = np.random.default_rng(7)
    batch = gram_rows([ngram_join.sketch(rnd.integers(0, 2**63, 100).astype(np.uint64))] * 9)
    for parts in ([batch], [batch.slice(i, 1) for i in range(9)], [batch.slice(0, 8), batch.slice(8)]):
        once, whole = ({(a, b) for x in meet(iter(parts)) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)} for meet in (ngram_join._to_first(75, 8), ngram_join._across(75)))
        assert once == whole and len(once) == 36


@pytest.mark.parametrize("seed", [4, 5])
def test_join_of_skewed_short_texts(seed, spark):
    """Short texts whose every common n-gram is in hundreds of others: all signatures that similar ones share are large."""
    rnd = random.Random(seed)
    docs = []
    for i in range(300):
        copy = [f"b{j}" for j in range(16)]
        for _ in range(rnd.randint(1, 2)):
            copy[rnd.randrange(16)] = f"e{rnd.randint(0, 10**6)}"
        docs.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_jaccard(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_join_real_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_jaccard(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_join_odd(odd_docs, no_docs):
    rows = ngram_join.op1_ngram_jaccard(odd_docs).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert len(rows) == odd_docs.count()
    assert got[1] == got[2] == got[10] == (got[1][0], 1) and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5)
    assert got[9] == (1, 8) and got[7][1] == 6
    assert ngram_join.op1_ngram_jaccard(no_docs).count() == 0
    kept = ngram_join.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 8, 11, 12, None}


def test_signatures_are_certain_below_the_limit():
    """Sets at the limit share a signature, for sizes whose parts are all emitted."""
    signer, rnd = ngram_join.Signer(), np.random.default_rng(1)
    for n in range(1, 120):
        for _ in range(3):
            d = int(n // 7)
            x = rnd.integers(0, 2**63, n + d).astype(np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[d:])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert len(np.intersect1d(signer(a), signer(b)))


def gram_rows(sketches):
    """Rows of one n-gram, each of its own component."""
    k = len(sketches)
    columns = [pa.array(np.full(k, 5)), pa.array(np.arange(k)), pa.array(np.zeros(k, np.int32)), pa.array(np.full(k, 100, np.int32)), pa.array(np.arange(k)), pa.array(sketches, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[*ngram_join._ROW, "sketch"])


def test_rows_of_an_ngram_meet_by_their_sketches():
    """A large group of texts that only an n-gram joins makes no pairs, one of similar texts all of them."""
    rnd = np.random.default_rng(3)
    sketch = lambda: ngram_join.sketch(rnd.integers(0, 2**63, 100).astype(np.uint64))
    count = lambda meet, sketches: sum(len(x) for x in meet(iter([gram_rows(sketches[:70]), gram_rows(sketches[70:])][: 1 + (len(sketches) > 70)])))
    apart, same = [sketch() for _ in range(60)], [sketch()] * 60
    assert count(ngram_join._across(75), apart) == 0 and count(ngram_join._across(75), same) == 60 * 59 // 2
    assert count(ngram_join._to_first(75, 8), apart) == 0 and count(ngram_join._to_first(75, 8), same) == 8 * 52 + 8 * 7 // 2


def test_ngrams_of_one_row_are_left_out():
    rnd = random.Random(5)
    grams = sorted(rnd.choice([rnd.randint(0, 40), rnd.randint(0, 10**6)]) for _ in range(300))
    for size in (1, 2, 7, 300):
        batches = (pa.record_batch({"gram": pa.array(grams[i : i + size], pa.int64()), "row": pa.array(range(i, min(i + size, 300)))}) for i in range(0, 300, size))
        got = [(g, r) for b in ngram_join._of_several(batches) for g, r in zip(b.column("gram").to_pylist(), b.column("row").to_pylist(), strict=True)]
        assert got == [(g, i) for i, g in enumerate(grams) if grams.count(g) > 1]


def test_mixed_nodes_without_their_pairs(spark, monkeypatch):
    """Nodes whose first is of another class, or has another such node; no table or join holds a row for each pair."""
    rnd = random.Random(6)
    component = {i: i if i < 120 and i % 3 else 300 for i in range(400)}
    pairs = sorted({(rnd.randint(0, 19) if b < 200 else rnd.randint(200, 219), b) for b in range(20, 400) if not 200 <= b < 220 for _ in range(30)})
    mixed = {a for a, b in pairs if component[a] != component[b]}
    expected = {x for a, b in pairs if a in mixed for x in (a, b)}
    rows = []
    monkeypatch.setattr(ngram_join, "written", lambda df: rows.append(df.count()) or df)
    found = ngram_join._mixed(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(i, i, c) for i, c in component.items()], "node long, id long, component long"))
    got = {r.node for r in found.collect()}
    assert expected <= got and len(got - expected) <= 2 and 0 < len(expected) < 400
    assert sum(rows) <= 400 < len(pairs)


def edit_distance(item, part):
    row = [0] * (len(part) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(part, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_recall_and_precision(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)  # noqa: E731  A-Z alone, as the operator
    items = {r.item_id: lower(r.text).split() for r in bench.collect()}
    rnd, rows, planted = random.Random(3), [], []
    for k in range(300):
        i = rnd.choice(sorted(items))
        w, n = list(items[i]), len(items[i])
        for _ in range(rnd.choice([0, 1, n // 8, n // 5])):
            p, how = rnd.randrange(len(w)), rnd.random()
            w[p : p + 1] = [] if how < 0.3 else [f"z{rnd.randint(0, 999)}"] if how < 0.7 else [w[p], "y"]
        text = [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 60))]
        q = rnd.randint(0, len(text))
        text[q:q] = w
        rows.append((k, " ".join(text)))
        planted.append((k, i))
    rows += [(1000 + k, " ".join(rnd.choice(items[rnd.choice(sorted(items))]) for _ in range(80))) for k in range(50)]
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    texts = {k: lower(t).split() for k, t in rows}
    for (d, i), x in got.items():
        assert x == edit_distance(items[i], texts[d]) <= len(items[i]) // 4
    due = [(d, i) for d, i in planted if edit_distance(items[i], texts[d]) <= len(items[i]) // 4]
    assert sum(x in got for x in due) >= 0.98 * len(due) and len(due) > 200
    assert not any(d >= 1000 for d, _ in got)


def test_items_of_every_length(spark):
    """Verbatim copies are certain at every length; at the limit of edits nearly all are found."""
    rnd = random.Random(8)
    word = lambda: f"v{rnd.randint(0, 4000)}"
    sizes = [1, 2, 3, 4, 5, 6, 7, 8, 40, 59, 60, 61, 75, 96, 130, 400, 1600, 5000]
    items, docs, verbatim, edited, number = [], [], [], [], 0
    for n in sizes:
        for _ in range(20 if n < 1000 else 5):
            item = [f"i{number}n{n}", *(word() for _ in range(n - 1))][:n] if n > 1 else [f"only{number}"]
            items.append((number, " ".join(item)))
            copy = list(item)
            spots = rnd.sample(range(n), n // 4)
            for p in sorted(spots, reverse=True):
                copy[p : p + 1] = rnd.choice([[], ["zz"], [copy[p], "yy"]])
            for w, to in ((item, verbatim), (copy, edited)):
                before, after = ([word() for _ in range(rnd.randint(0, 300))] for _ in range(2))
                to.append((len(docs), number))
                docs.append((len(docs), " ".join([*before, *w, *after])))
            number += 1
    clean = [(10**6 + i, " ".join(word() for _ in range(800))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(spark.createDataFrame(docs + clean, "doc_id long, text string").repartition(8), bench).collect()}
    texts, wanted, length = dict(docs), dict(items), {i: len(t.split()) for i, t in items}
    assert [x for x in verbatim if got.get(x) != 0] == []
    for n in sizes:
        due = [x for x in edited if length[x[1]] == n]
        assert sum(x in got for x in due) >= 0.95 * len(due), n
    for (d, i), x in got.items():
        if length[i] <= 130:
            assert x <= length[i] // 4 and x == edit_distance(wanted[i].split(), texts[d].split())
    assert not any(d >= 10**6 and length[i] >= 8 for d, i in got)


def test_short_items_equal_brute_force(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 7)))) for i in range(40)] + [(40, None), (41, " ")]
    docs = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    due = {(d, i): x for d, t in docs for i, w in items if w and w.split() and (x := edit_distance(w.split(), t.split())) <= len(w.split()) // 4}
    assert got == due


def test_decontamination_odd(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    rows = decontam.op6_decontamination(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count() and {r.doc_id for r in rows if r.contaminated} == {1, 2, 10}
    kept = decontam.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.where("doc_id is null").count() == 2
    assert decontam.op6_decontamination(no_docs, bench).count() == 0
    assert decontam.leaks(odd_docs, bench.limit(0)).count() == 0


def test_neighbours(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in ann.op3_nn_descent(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert all(abs(s - d[ids == v][0]) < 1e-9 for v, s in found) and found == sorted(found, key=lambda r: (r[1], r[0]))
        hits += len({v for v, _ in found} & set(ids[best].tolist()))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and hits >= 9 * len(got)


def test_neighbours_odd(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [1.0]), (105, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows = bad + [(i, [1.0, 2.0]) for i in range(0, 40, 2)] + [(i, [float(i), 3.0]) for i in range(1, 40, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op3_nn_descent(df).orderBy("rank").collect()]
    assert got == [(0, k, 2 * k, 0.0) for k in range(1, 11)]
    few = ann.op3_nn_descent(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert ann.op3_nn_descent(df.limit(0)).count() == 0
    assert ann.op3_nn_descent(df.where(F.col("vec_id") == 0)).count() == 0
