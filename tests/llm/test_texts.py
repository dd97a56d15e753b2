"""Encoding, repeats, line and sentence dedup, URLs, personal data and toxicity."""

import hashlib
import random
import re
import zlib

import pytest
import tiktoken
from helpers import duck_rows, rows_of
from pyspark.sql import functions as F

from granary.llm import bpe, decontam, line_dedup, ngram_join, pii, queries, repeats, sentence_dedup, textkit, toxicity, url_filter


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(name, spark, sf, duck):
    assert rows_of(queries.queries()[name](spark, sf)) == duck_rows(duck, queries.oracle_sql()[name])


def encoding():
    path, pattern = bpe.public_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_library_and_round_trips():
    path, pattern = bpe.public_vocabulary()
    own, lib, rnd = bpe.Bpe(bpe.read_ranks(path), pattern), encoding(), random.Random(2)
    alphabet = "ab \n\t\r\x1c\x85\u3000é1²_=-'sdtlm.😀漢ßñ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(800)] + [None, "", "a" * 30_000, "=" * 5000, "ab" * 9000, "<|endoftext|>"]
    ids, ends = own.encode(texts)
    for k, t in enumerate(texts):
        a = ids[(ends[k - 1] if k else 0) : ends[k]].tolist()
        assert a == lib.encode_ordinary(t or "")
    assert [x.decode() for x in own.decode(ids, ends)] == [t or "" for t in texts]


def test_queue_obeys_ranks_in_any_order():
    """A vocabulary whose merges bring up earlier ranks again."""
    ranks = {bytes([b]): 200 + i for i, b in enumerate(b"abc")} | {b"bc": 9, b"abc": 3, b"ab": 11, b"aabc": 1}
    lib = tiktoken.Encoding("odd", pat_str=r"[abc]+", mergeable_ranks=ranks, special_tokens={})
    own, rnd = bpe.Bpe(ranks, r"[abc]+"), random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        assert own.encode([t])[0].tolist() == lib.encode_ordinary(t)


def test_bpe_frames(odd_docs, no_docs):
    path, pattern = bpe.public_vocabulary()
    lib = encoding()
    out = bpe.encode(odd_docs, path, pattern, digests=True)
    back = bpe.decode(out, path, pattern).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, r.text or "") for r in odd_docs.collect())
    for r in back:
        ids = lib.encode_ordinary(r.text)
        assert (list(r.ids), r.n_tokens, r.score) == (ids, len(ids), 7)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert bpe.encode(no_docs, path, pattern).count() == 0 and bpe.op2_byte_bpe(no_docs).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in bpe.op2_byte_bpe(odd_docs.where("text is null and doc_id = 3")).collect()] == [(3, 0, empty, empty)]


def brute_repeats(rows, least=50):
    first, out = {}, {}
    texts = sorted([(d, (t or "").encode()) for d, t in rows if d is not None], key=lambda x: x[0])
    for d, b in texts:
        for i in range(len(b) - least + 1):
            first.setdefault(b[i : i + least], d)
    for d, b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] < d:
                mark[i : i + least] = b"\1" * least
        runs = sum(1 for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1]))
        out[d, hashlib.sha256(b).hexdigest()] = (d, len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, sf, odd_docs):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made = [(9001, "a" * 300), (9002, "b" + "a" * 120 + "c"), (9003, "x" * 49), (9004, "x" * 50), (9005, "x" * 50), (9006, "ab" * 100), (9007, "q" + "ba" * 60), (9004, "y" * 70 + "x" * 51)]
    odd = [(r.doc_id + 20_000 if r.doc_id else None, (r.text or "")[:3000] or r.text) for r in odd_docs.collect()]
    rows = real + made + odd
    got = repeats.op4_suffix_array(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = brute_repeats(rows)
    assert {tuple(r) for r in got if r.doc_id is not None} == set(want.values())
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)


def test_maximal_repeats_have_all_occurrences():
    a, b = b"the quick brown fox jumps over the lazy dog again and again", b"0123456789"
    group, piece, offset, length, lead, lead_at = repeats.maximal([b"x" + a + b"1", b"y" + a + b"2", b"z" + a + b"3" + b], 50)
    whole = [(p, o, n, f, g) for p, o, n, f, g in zip(*(x.tolist() for x in (piece, offset, length, lead, lead_at)), strict=True) if n == len(a)]
    assert sorted(whole) == [(0, 1, len(a), 0, 1), (1, 1, len(a), 0, 1), (2, 1, len(a), 0, 1)] and len(set(group.tolist())) >= 1


def test_groups_of_long_repeats(spark):
    """Stretches of 50 to 2,000 bytes in several documents are one group each, with all of their places."""
    rnd = random.Random(7)
    noise = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    passages, rows, due = [noise(n, "abcdefgh ") for n in (50, 51, 84, 85, 300, 2000)], [], {}
    for i in range(30):
        text = noise(rnd.randint(0, 80), "ijklmnop")
        for k in rnd.sample(range(len(passages)), 2):
            text += chr(33 + i)  # bounds that no two documents have in common
            due.setdefault(k, set()).add((i, len(text), len(passages[k])))
            text += passages[k] + chr(33 + i) + noise(rnd.randint(5, 30), "qrstuvw")
        rows.append((i, text))
    got = {}
    for r in repeats.maximal_repeats(spark.createDataFrame([*rows, (99, rows[0][1]), (None, rows[1][1])], "doc_id long, text string")).collect():
        got.setdefault(r.group, set()).add((r.doc_id, r.start, r.length))
    assert sorted(got.values(), key=sorted) == sorted((x for x in due.values() if len(x) > 1), key=sorted)


def test_shared_anchors():
    """What is put out does not depend on where batches end, and frequent anchors are marked."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    rows = sorted({(int(k), int(n)) for k, n in zip(rnd.integers(0, 60, 900), rnd.integers(0, 700, 900), strict=True)} | {(70, i) for i in range(repeats.HOT)} | {(71, i) for i in range(repeats.HOT - 1)} | {(72, 1)})
    rows = sorted(rows + rows[::3])
    nodes = {}
    for k, n in rows:
        nodes.setdefault(k, set()).add(n)
    due = sorted({(k | (len(nodes[k]) >= repeats.HOT) << repeats._BITS, n) for k, n in rows if len(nodes[k]) > 1})
    for size in (1, 7, 300, 5000):
        batches = (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=["key", "node"]) for i in range(0, len(rows), size))
        assert sorted((k, n) for b in repeats._shared(repeats.HOT)(batches) for k, n in zip(b["key"].to_pylist(), b["node"].to_pylist(), strict=True)) == due


@pytest.mark.parametrize("hot", [500, 20])
def test_repeats_carry_long_groups(hot, monkeypatch, spark):
    """A passage in many documents, with arrays of few pieces each, and with frequent anchors."""
    monkeypatch.setattr(repeats, "RUN", 60_000)
    monkeypatch.setattr(repeats, "HOT", hot)
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(rnd.choice("ijklmnop ") for _ in range(rnd.randint(0, 90))) + passage[rnd.randint(0, 40) :] + "".join(rnd.choice("qrstuv ") for _ in range(40))) for i in range(200)]
    got = repeats.op4_suffix_array(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == set(brute_repeats(rows).values())


def test_line_dedup_odd(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    before = {r.doc_id: r.text for r in odd_docs.collect()}
    assert texts[2] == "" and texts[3] is None and all(texts[d] == before[d] for d in texts if d != 2)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_extends_both_ways(spark):
    rows = [(1, "a\nb\n\nc\nd\ne"), (2, "x\na\nb\nc\nd\ne\ny"), (3, "p\nb\nc\n\nq\nd\ne"), (4, "r\nr\nr\nr\nr\nr")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x\ny", 3: rows[2][1], 4: "r"}


def test_line_dedup_long_lines(spark):
    """A passage of over 50 words that fills one line or two is a run; shorter ones are not."""
    one, half, short = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 51), ("b", 30), ("c", 20)))
    rows = [(1, f"x\n{one}\ny\n{half}\n{half}2"), (2, f"{one}\nz"), (3, one), (4, f"q\n{half}\n\n{half}2\nr"), (5, f"{half}\n{short}"), (6, f"p\n{one}\n{one}")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "z", 3: "", 4: "q\nr", 5: rows[4][1], 6: "p"}


def test_line_dedup_of_equal_lines(spark):
    """Texts of one line many times, and of a few in turn, take no more than linear work."""
    rows = [(1, "\n".join(["same line"] * 20_000)), (2, "\n".join(["one", "two", "three", "four"] * 5_000)), (3, "x\nsame line\nsame line\nsame line\ny")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "same line" and got[2] == "one\ntwo\nthree\nfour" and got[3] == "x\ny"


def test_line_dedup_counts_all_earlier_occurrences(spark):
    """A run goes also where lines of it come first in another context."""
    rows = []
    for k in range(20):
        a, b, d, q = (f"{x} of case {k}" for x in "abdq")
        rows += [(3 * k, f"{a}\n{b}\n{d}"), (3 * k + 1, f"{q}\n{a}\n{b}"), (3 * k + 2, f"new {k}\n{q}\n{a}\n{b}")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: f"new {d // 3}" if d % 3 == 2 else t for d, t in rows}


def test_sentence_spans(spark, odd_docs, no_docs):
    run = "This sentence is here for the words. That one follows it closely, as it should. A third one ends it."
    rows = [(1, run), (2, "Something new first. " + run + " And more."), (3, f"{run} {run}"), (4, "This sentence is here for the words. That one follows it closely, as it should."), (5, "Other. " + run.upper().replace(" ", "  "))]
    got = {r.doc_id: r.text for r in sentence_dedup.dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: run, 2: "Something new first. And more.", 3: "", 4: rows[3][1], 5: "Other. "}
    out = sentence_dedup.dedup_sentences(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {r.text for r in out.where("doc_id = 3").collect()} == {None} and sentence_dedup.dedup_sentences(no_docs).count() == 0


def test_sentence_spans_short(spark):
    """Whole copies of short texts go, short runs in longer ones stay."""
    rows = [(1, "Yes. No. Well."), (2, "yes.  No. Well."), (3, "Say: Yes. No. Well."), (5, "Hi"), (6, "hi"), (7, " \n ")]
    got = {r.doc_id: r.text for r in sentence_dedup.dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1], 5: "Hi", 6: "", 7: " \n "}


def test_sentence_spans_planted_within_sentences(spark):
    """Passages of 60 to 120 words cut from and put into the middle of sentences are found; texts of common words alone are left."""
    rnd = random.Random(8)

    def prose(n):
        out = []
        for i in range(n):
            out.append(rnd.choice(["the", "of", "and", "in", f"w{rnd.randint(0, 5000)}"]))
            if rnd.random() < 0.12:
                out[-1] += rnd.choice([",", ".", ".", ";"])
        return out

    hosts, rows, planted = [prose(rnd.randint(150, 500)) for _ in range(200)], [], set()
    for i, words in enumerate(hosts):
        if i >= 120:
            source = rnd.choice(hosts[:60])
            n = rnd.randint(60, 120)
            p, q = rnd.randrange(len(source) - n), rnd.randrange(len(words))
            words = [*words[:q], *source[p : p + n], *words[q:]]
            planted.add(i)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.text for r in sentence_dedup.dedup_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = {d for d, t in rows if got[d] != t}
    assert changed <= planted and len(changed) >= 0.95 * len(planted)


def test_columns_of_any_name_are_kept(spark):
    """Helper names of the operators, in any case, come through unchanged."""
    names = ["_d", "_v", "_gone", "_kept", "_text", "_new", "_leak", "_toxic", "_tokens", "_fits", "_index", "_runs", "_n", "d", "v", "x", "H", "lo", "hi", "version", "n_removed", "a.b", "component_id", "node", "score", "ids"]
    rows = [(1, "alpha beta\ngamma\ndelta\nepsilon", *range(len(names))), (2, "alpha beta\ngamma\ndelta\nepsilon", *range(len(names))), (3, "me@example.com wrote", *range(len(names)))]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in names)]))
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    for made in (line_dedup.dedup_lines(df), sentence_dedup.dedup_sentences(df), pii.replace_pii(df, "k"), decontam.decontaminate(df, bench), ngram_join.keep_one_each(df), toxicity.drop_toxic(df, model), bpe.decode(bpe.encode(df.drop("ids"), *bpe.public_vocabulary()), *bpe.public_vocabulary()).select("doc_id", "text", *(f"`{n}`" for n in names))):
        if "ids" in made.columns and dict(made.dtypes)["ids"] != "int":
            made = made.withColumn("ids", F.lit(names.index("ids")))
        assert made.columns == df.columns
        for r in made.collect():
            assert list(r)[2:] == list(range(len(names)))
    pages = df.withColumnRenamed("text", "url")
    out = url_filter.filter_urls(pages, url_filter.default_rules())
    assert [c for c in out.columns if c in pages.columns] == pages.columns and out.count() == 3


def test_urls(spark):
    urls = ["http://A.Example.ORG/en/12?x", "https://example.org/en/2", "https://example.org/es/", "ftp://x.com/fr/a#b", "http://com/de/1", "http://notcom/de/1", "http://y.com/de", "no scheme", None, "http://", "http://www.spam-farm.net/a", "http://h?q://z", "x://org/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op5_url_filter(df).collect()}
    assert got == {
        0: ("a.example.org", "/en/12", "example.org/en/1", "block"), 1: ("example.org", "/en/2", "org/", "allow"), 2: ("example.org", "/es/", "example.org/es/", "block"), 3: ("x.com", "/fr/a", "com/fr/", "allow"),
        4: ("com", "/de/1", "com/de/", "block"), 5: ("notcom", "/de/1", None, "allow"), 6: ("y.com", "/de", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"),
        10: ("www.spam-farm.net", "/a", None, "block"), 11: ("h", "", None, "allow"), 12: ("org", "/", "org/", "allow"),
    }
    assert url_filter.op5_url_filter(df.limit(0)).count() == 0


def test_many_rules(spark):
    """Thousands of rules; each URL meets those of its own tokens."""
    rules = [url_filter.prefix_rule("block", f"site{i}.net", f"/a/{i}/") for i in range(5000)] + url_filter.default_rules()
    df = spark.createDataFrame([(i, f"http://www.site{i}.net/a/{i + i % 2}/x") for i in range(0, 5000, 7)] + [(9001, "https://best-casino.de/"), (9002, "https://bestcasino.de/"), (9003, "https://x.poker")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {i: "allow" if i % 2 else "block" for i in range(0, 5000, 7)} | {9001: "block", 9002: "allow", 9003: "block"}


def test_pii(spark, odd_docs, no_docs):
    rows = [
        (1, "Mail Ann.Lee@Mail.example.com or ann.lee@mail.EXAMPLE.com call +1 (988) 555-2485 or +1 988-555-2485."), (2, "card 4111 1111 1111 1111 and 4111111111111111; ip 10.2.33.255 ssn 427-43-1234"),
        (3, "Mr. Paul Smith met Mrs Eva Jones and Г-жа Анна Петрова"), (4, "ann.lee@mail.example.com 10.2.33.255"), (None, "ann.lee@mail.example.com"), (5, None), (6, "nothing"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_pii(df, "k").collect()}
    mails = re.findall(r"\S+@\S+", got[1])
    assert mails[0].lower() == mails[1].lower() == got[4].split()[0] == got[None] and mails[1].endswith(".com") and got[4].split()[0] != "ann.lee@mail.example.com"
    cards = re.search(r"card ([\d ]{19}) and (\d{16})", got[2])
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111"
    digits = [int(c) for c in cards[2]][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert got[4].split()[1] == re.search(r"ip (\S+)", got[2])[1] and all(0 <= int(x) <= 255 for x in got[4].split()[1].split("."))
    assert re.match(r"Mr\. (?:%s) \w{5} met Mrs (?:%s) \w{5} and Г-жа (?:%s) [А-Яа-я]{7}$" % tuple("|".join(pii._GIVEN[k]) for k in (("m", "latin"), ("f", "latin"), ("f", "cyrillic"))), got[3])
    assert got[5] is None and got[6] == "nothing"
    out = pii.replace_pii(odd_docs, "k")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count() and pii.replace_pii(no_docs, "k").count() == 0


def test_surrogates_are_distinct(spark):
    """Over half of all octets of one digit: draws must collide and be drawn again."""
    rows = [("ip", f"{a}.{b}.{c}.1") for a in range(1, 10) for b in range(10) for c in range(10)]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "key").collect()
    values = [r.value for r in got]
    assert len(values) == len(set(values)) == len(rows) and not set(values) & {c for _, c in rows}


def test_full_formats_widen(spark):
    """All addresses of four one-digit octets but one are real; secrets equal to their key word lose the right part only."""
    rows = [("ip", f"{a}.{b}.{c}.{d}") for a in range(10) for b in range(10) for c in range(10) for d in range(10)][1:]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "key").collect()
    values = [r.value for r in got]
    assert len(values) == len(set(values)) == len(rows) and not set(values) & {c for _, c in rows} and all(int(x) < 256 for v in values for x in v.split("."))
    wide = spark.createDataFrame([("email", "Al@b.com", "al@b.com"), ("name", "Mr Li", "Mr Li"), ("phone", "+1 234-567-8901", "12345678901")], "kind string, mention string, canon string")
    for r in wide.select("kind", pii.rendered(F.col("kind"), F.col("mention"), F.col("canon"), pii.surrogate("k", F.col("kind"), F.col("canon"), F.lit(30))).alias("new")).collect():
        assert re.fullmatch({"email": r"[a-z]{2}[A-Z][a-z]@[a-z]\.com", "name": r"Mr [A-Z][a-z]{3}", "phone": r"\+\d \d{3}-\d{3}-\d{6}"}[r.kind], r.new), r.new
    text = pii.replace_pii(spark.createDataFrame([(1, "password: password token=\"token123\"")], "doc_id long, text string"), "k").first().text
    assert re.fullmatch(r"password: (?!password)[a-z]{8} token=\"(?!token123)[a-z]{5}\d{3}\"", text), text


def test_crowded_formats_end(spark):
    """Cards, addresses and secrets far beyond what their formats hold get distinct surrogates, and none of a real entity, without an end to the draws."""
    rows = [("secret", f"{c}") for c in "abcdefghijklmnopqrstuvwxyz0123456789"] + [("card", f"4{d:02d}") for d in range(100)] + [("ssn", f"{d:02d}") for d in range(100)]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "key").collect()
    for kind in ("secret", "card", "ssn"):
        values, real = [r.value for r in got if r.kind == kind], {c for k, c in rows if k == kind}
        assert len(values) == len(set(values)) == len(real) and not set(values) & real
    far = spark.createDataFrame([("ip", "1.2.3.4")], "kind string, canon string").select(pii.surrogate("k", F.col("kind"), F.col("canon"), F.lit(2 * pii.WIDE)).alias("v")).first().v
    assert re.fullmatch(r"\d+(\.\d+){4}", far)


def test_pii_against_plain_replacer(spark, sf):
    """Over the real documents: what stands between mentions is untouched, equal entities have one surrogate, different ones different ones."""
    import regex

    any_ = regex.compile(pii._ANY.replace(r"\z", r"\Z"))
    kinds = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}

    def entity(mention):
        kind = next(k for k, p in kinds.items() if p.fullmatch(mention))
        squeezed = regex.sub(r"[^0-9]", "", mention)
        value = {"email": mention.lower(), "card": squeezed, "phone": squeezed, "ssn": squeezed, "iban": mention.replace(" ", "")}.get(kind, mention)
        return kind, regex.search(r"[=:]\s{0,2}[\"']?([A-Za-z0-9+/_-]+)[\"']?$", mention)[1] if kind == "secret" else value

    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    new, of, seen = {r.doc_id: r for r in pii.op7_pii(df).collect()}, {}, 0
    for r in df.collect():
        text, at, pattern, due = r.text or "", 0, "", []
        for m in any_.finditer(text):
            pattern += regex.escape(text[at : m.start()]) + "(.+?)"
            due.append(entity(m[0]))
            at = m.end()
        assert new[r.doc_id].n_entities == len(due)
        found = regex.fullmatch(pattern + regex.escape(text[at:]), new[r.doc_id].text or "", regex.DOTALL)
        assert found, r.doc_id
        for e, value in zip(due, found.groups(), strict=True):
            value = regex.sub(r"[\s().+-]", "", value) if e[0] in ("phone", "card", "ssn", "iban") else value.lower() if e[0] == "email" else regex.sub(r".*[=:]\s*", "", value).strip("\"'") if e[0] == "secret" else value
            assert of.setdefault(e, value) == value and value != e[1]
            seen += 1
    assert seen > 20 and len({(k, v) for (k, _), v in of.items()}) == len(of) and not {(k, v) for (k, _), v in of.items()} & set(of)


def test_toxicity_of_documents(spark, sf):
    """Scores equal a plain loop over the model, and hold on held-out labels of the tables."""
    import numpy as np
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, learn=toxicity.remainder(F.col("doc_id")) != 0)
    assert (toxicity.fit(docs.repartition(7), labels, learn=toxicity.remainder(F.col("doc_id")) != 0)[0] == model[0]).all()
    got = {r.doc_id: r for r in toxicity.op9_toxicity(docs, labels).collect()}
    p = toxicity.Params()
    for r in docs.orderBy("doc_id").limit(40).collect():
        data = np.frombuffer((r.text or "").encode() + b" ", np.uint8)
        grams = sorted((int(a), int(b)) for at, bucket in toxicity.gram_buckets(data, p.grams, p.bucket_bits) for a, b in zip(at, bucket, strict=True))
        _, lo, hi = toxicity.windows_of(data, np.array([0, len(data)]), p)
        z = []
        for a, b in zip(lo, hi, strict=True):
            inside = [model[0].astype(np.float32)[k] for at, k in grams if a <= at < b]
            z.append(sum(map(float, inside)) / max(1, len(inside)) + model[1])
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-max(-40, min(40, max(z)))))) < 1e-6
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))  # enough toxic ones to learn from
    got = {r.doc_id: r for r in toxicity.op9_toxicity(docs, labels).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.where("toxic is not null").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and sum(a for a, b in held if b) >= 0.8 * sum(b for _, b in held)
    assert toxicity.score_texts(pa.array([None, ""]), *model, p).tolist() == [1 / (1 + np.exp(-model[1]))] * 2


def test_long_labelled_texts_do_not_stop_training(spark):
    rows = [(i, f"good text number {i} " * 5 + ("blorkface " * 3 if i % 2 else "")) for i in range(60)] + [(100 + i, "x" * 400_000) for i in range(3)]
    labels = [(i, i % 2) for i in range(60)] + [(100 + i, 1) for i in range(3)]
    out = toxicity.op9_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id < 100").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in out) >= 57


def test_toxicity_held_out(spark):
    rnd = random.Random(6)
    syllables = ["an", "er", "th", "on", "in", "re", "at", "en", "nd", "ou", "ea", "ti"]
    insults = ["blorkface", "grumblewit", "snarkbrain"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(1200):
        words, toxic = [word() for _ in range(rnd.randint(5, 120))], i % 4 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                w = rnd.choice(insults)
                if zlib.crc32(str(i).encode()) % 5 == 0:  # a spelling that training never sees
                    k = rnd.randrange(2, len(w) - 1)
                    w = w[:k] + w[k] + w[k:]
                words.insert(rnd.randrange(len(words) + 1), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    out = toxicity.op9_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_odd(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.op9_toxicity(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    some = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (8, 0), (6, None)], "doc_id long, toxic int")
    assert toxicity.op9_toxicity(odd_docs, some).where("score between 0 and 1").count() == odd_docs.count()
    assert toxicity.op9_toxicity(no_docs, some).count() == 0
    model = toxicity.fit(odd_docs, some)
    scored = toxicity.score(odd_docs, model)
    assert scored.columns == ["doc_id", "text", "score"] and dict(scored.dtypes)["score"] == "double"


def test_words_and_shingles():
    import pyarrow as pa

    sets = list(textkit.shingle_sets(pa.array(["a b c d e f", "A  b\tc\nd e F", "a b", "b a", "", None, " \n", "é a b c d e"]), 5))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 0, 2] and (sets[0] == sets[1]).all() and sets[2][0] != sets[3][0] and len(set(sets[0]) & set(sets[7])) == 1


def test_pipeline_of_odd_tables(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline as p

    shaped = lambda d: d.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "score")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shaped(odd_docs).write.parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, 8, 11, 12, None} and out.where("doc_id is null").count() == 2
    docs = shaped(no_docs)
    for _, stage in p.STAGES:
        docs, before = stage(spark, docs if "text" in docs.columns else shaped(no_docs), str(tmp_path)), docs
        assert docs.count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    final = p.run(spark, sf)
    assert 0 < len(ids) < n and {r.doc_id for r in final.select("doc_id").collect()} == ids
    assert final.where(F.size("ids") != F.col("n_tokens")).count() == 0
