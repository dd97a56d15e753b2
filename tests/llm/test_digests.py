"""Fingerprints of improbable features."""

import hashlib
import math
import random
import string
from collections import Counter

import numpy as np
import pytest

from granary.llm import digests
from granary.llm.textkit import _BASE, U64, mix

P = digests.Params(window=8, run=16, points=3, short=40, small=4, room=12)


def level(window):
    s = sum(round(c * math.log2(c) * digests._SCALE) for c in Counter(window).values())
    top = math.log2(len(window))
    return min(1000, max(0, int((top - s / (digests._SCALE * len(window))) * (1000 / top) + 1e-6)))


def hashed(piece, kind):
    total = sum(int(digests._VALUE[b]) * pow(int(_BASE), i, 1 << 64) for i, b in enumerate(piece)) % (1 << 64)
    return int(mix(np.array([total], U64) + U64(kind))[0])


def plain_features(text, rank, p):
    n = len(text) - p.window + 1
    levels = [level(text[i : i + p.window]) for i in range(max(n, 0))]
    key = [(1 << 20 if x < p.least_entropy else int(rank[x]), i) for i, x in enumerate(levels)]
    runs = [key[i : i + p.run] for i in range(max(1, n - p.run + 1))] if n > 0 else []
    points = Counter(min(r) for r in runs)
    need = min(p.points, max(1, n - p.run + 1))
    good = [i for (k, i), c in points.items() if c >= need and k < 1 << 20] or [i for _, i in points]
    out = [hashed(text[i : i + p.window], 0) for i in sorted(good)]
    if len(text) < p.short:
        out += [hashed(text[i : i + p.small], 1) for i in range(len(text) - p.small + 1)]
    if 0 < len(text) < p.small:
        out.append(hashed(text, 2))
    return list(dict.fromkeys(out))


def some_texts(n=60):
    rnd = random.Random(3)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(1, 9))) for _ in range(200)] + ["-" * 12, "   ", "é漢"]
    return [" ".join(rnd.choices(words, k=rnd.randint(0, 60))).encode() for _ in range(n)] + [b"", b"a", b"abc", b"=" * 100, b"ab" * 300]


def test_features_equal_plain():
    texts = some_texts()
    counts = sum((np.bincount([level(t[i : i + P.window]) for i in range(len(t) - P.window + 1)], minlength=1001) for t in texts if len(t) >= P.window), np.zeros(1001, int))
    assert digests.level_counts(texts, P).tolist() == counts.tolist()
    rank = np.empty(1001, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(1001)
    text, h = digests.features(texts, rank, P)
    for i, t in enumerate(texts):
        assert h[text == i].tolist() == plain_features(t, rank, P)
    chains = digests.filters(texts, rank, P)
    for t, c in zip(texts, chains, strict=True):  # the chain holds every feature, in filters of twelve
        found = plain_features(t, rank, P)
        assert c[:, 0].tolist() == [len(found[a : a + 12]) for a in range(0, len(found), 12)]
        for k, x in enumerate(found):
            bits = np.unpackbits(c[k // 12, 1:])
            assert all(bits[(x >> (11 * j)) & 2047] for j in range(5))
        assert np.array_equal(digests.read(c.tobytes().hex(), P), c)


def test_likeness():
    texts = [t for t in some_texts(200) if len(t) > 120]
    p = digests.Params()
    rank = np.arange(1001)[::-1].copy()
    chains = digests.filters([*texts, *(t[: len(t) * 2 // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:] + texts[:1], strict=True))], rank, p)
    own, edited = chains[: len(texts)], chains[len(texts) :]
    assert all(digests.likeness(a, a) == 1 for a in own) and all(digests.likeness(a, b) == pytest.approx(digests.likeness(b, a)) for a, b in zip(own, edited, strict=True))
    assert np.mean([digests.likeness(a, b) for a, b in zip(own, edited, strict=True)]) > 0.5
    assert np.mean([digests.likeness(a, b) for a, b in zip(own, own[1:], strict=False)]) < 0.15
    empty = digests.filters([b""], rank, p)[0]
    assert digests.likeness(empty, empty) == 1 and digests.likeness(empty, own[0]) == digests.likeness(own[0], empty) == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_documents(spark, sf, parts):
    """Edited copies against a plain walk down the doc_ids, whatever the number of ranges."""
    had = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = {r.doc_id: r for r in digests.op11_improbable_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    rows.sort(key=lambda r: -r[0])
    assert len(out) == len(rows)
    for (d, t), (e, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u, r = t or "", u or "", out[d]
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (digests.read(x) for x in (r.fingerprint, r.edited_fingerprint, out[e].fingerprint))
        assert (r.near_edited, r.near_next) == (digests.likeness(a, b), digests.likeness(a, c))
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault(t or "", out[d].fingerprint) == out[d].fingerprint
    assert np.mean([r.near_edited for r in out.values()]) > 0.6 and np.median([r.near_next for r in out.values()]) < 0.1


def test_odd_rows(spark, odd_docs, no_docs):
    out = digests.op11_improbable_digest(odd_docs).collect()
    assert digests.op11_improbable_digest(no_docs).count() == 0 and len(out) == odd_docs.count()
    texts = {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    for r in out:
        if r.doc_id is None:
            assert r.fingerprint is not None and r.edited_sha256 is None and r.near_next is None
        else:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {r.n_chars for r in out if r.doc_id == 3} == {0} and {r.fingerprint for r in out if r.doc_id in (3, 4)} == {""}
    eight = next(r for r in out if r.doc_id == 9)
    assert eight.near_next == 1 and eight.edited_sha256 == hashlib.sha256(b"shors").hexdigest() and len(texts) > 10
    two = [r for r in out if r.doc_id == 2]
    assert len(two) == 2 and all(r.near_next == 1 for r in two)
    one = digests.op11_improbable_digest(spark.createDataFrame([(5, "a single document")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]


def test_compared(spark):
    texts = some_texts(20)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = digests.fingerprints(docs, digests.fit(docs))
    pairs = prints.join(prints.selectExpr("doc_id + 1 as doc_id", "fingerprint as other"), "doc_id", "left")
    for r in digests.compared(pairs).collect():
        assert r.likeness is None if r.other is None else r.likeness == digests.likeness(digests.read(r.fingerprint), digests.read(r.other))
