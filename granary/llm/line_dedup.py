"""Removal of repeated runs of lines by winnowing. DataFrame functions only.

Lines that are not blank are hashed; ``gram`` lines make a fingerprint, and of every ``window`` consecutive fingerprints the least (the last
of equals) is selected, so any two places that share ``window + gram - 1`` lines share a selected fingerprint. Every run of fewer lines that has
over ``WORDS`` words is a fingerprint too. Fingerprints are joined by value; those that stand at one place only are done with.
From the others matches are extended both ways: each run of ``window + gram - 1`` lines around a selected one is hashed, and a
run whose hash an earlier place has is deleted, with blank lines inside. Longer repeats are covered by the runs in them, so a match is as long as
its lines are equal, and all earlier occurrences count, in whatever context they stand.

Counts and first places come from grouped aggregates, combined before the shuffle, so a line in a third of all documents makes
one row a task there; it stands on the large side of a join that Spark splits by itself. No place meets all others of a
group, and a text of equal lines takes time and memory in proportion to its lines.

Defined results: null texts stay null; empty texts are kept, and so are texts that hold no run. Rows with a null doc_id
are kept and are no one's first. Rows alike in doc_id and text are one document and are treated alike. Repeats
within a document count. All columns of the input are kept, whatever their names; only the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import let, named, unused, written

GRAM, WINDOW, WORDS = 2, 2, 50
_BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(lines: Column) -> Column:
    """(h, i, w) of every line that is not blank: hash, line number and number of words."""

    def described(x: Column, i: Column) -> Column:
        bare = F.trim(x, F.lit(_BLANK))
        return F.struct(F.when(bare != "", F.xxhash64(x)).alias("h"), i.cast("int").alias("i"), F.size(F.split(bare, r"\s+")).alias("w"))

    return F.filter(F.transform(lines, described), lambda s: s["h"].isNotNull())


def _starts(h: Column, size: int) -> Column:
    """First lines of all runs of so many lines."""
    return F.when(F.size(h) >= size, F.sequence(F.lit(0), F.size(h) - size)).otherwise(F.array().cast("array<int>"))


def selected(h: Column, gram: int, window: int) -> Column:
    """First lines of the selected fingerprints of an array of line hashes."""
    grams = F.transform(_starts(h, gram), lambda j: F.xxhash64(F.slice(h, j + 1, gram)))

    def picks(g: Column) -> Column:
        def least(j: Column) -> Column:
            return let(F.slice(g, j + 1, window), lambda part: (j + window - F.array_position(F.reverse(part), F.array_min(part))).cast("int"))

        return F.array_distinct(F.transform(_starts(g, window), least))

    return let(grams, picks)


def _code(p: Column, size: Column | int) -> Column:
    """A run as one number, so that Spark tells arrays of them apart by hashing."""
    return (p.cast("bigint") * 64 + size).cast("bigint")


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """(doc_id, version, lo, hi): line numbers from lo to hi of a document that repeat an earlier run."""
    least = window + gram - 1
    if least > 63:
        raise ValueError("window and gram of 64 lines together at most")
    text = F.col("text").cast("string")
    base = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64(text).alias("version"), line_hashes(_lines(text)).alias("s"))
    base = written(base.where(F.size("s") > 0).select("doc_id", "version", F.col("s.h").alias("h"), F.col("s.i").alias("i"), F.col("s.w").alias("w")))

    def long(size: int) -> Column:
        some = F.filter(_starts(F.col("h"), size), lambda p: sum((F.get("w", p + k) for k in range(size)), F.lit(0)) > words)
        return F.transform(some, lambda p: _code(p, size))

    def mark(code: Column) -> Column:
        # selected fingerprints have the size 0
        size = F.when(code % 64 == 0, gram).otherwise(code % 64).cast("int")
        return F.struct(F.xxhash64(F.slice("h", F.shiftright(code, 6).cast("int") + 1, size), size).alias("f"), code.alias("code"))

    codes = F.concat(F.transform(selected(F.col("h"), gram, window), lambda p: _code(p, 0)), *(long(k) for k in range(1, least)))
    marks = written(base.select("doc_id", "version", F.explode(F.transform(codes, mark)).alias("m")).select("doc_id", "version", "m.f", "m.code"))
    shared = marks.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    met = marks.join(shared, "f", "left_semi").groupBy("doc_id", "version").agg(F.collect_set("code").alias("codes"))

    def around(code: Column) -> Column:
        p = F.shiftright(code, 6)
        return F.when(code % 64 > 0, F.array(code)).otherwise(F.array(*(_code(p - k, least) for k in range(least - gram + 1))))

    def run(code: Column) -> Column:
        p, size = F.shiftright(code, 6).cast("int"), (code % 64).cast("int")
        return F.struct(F.xxhash64(F.slice("h", p + 1, size), size).alias("h"), F.get("i", p).alias("lo"), F.get("i", p + size - 1).alias("hi"))

    def parts(runs: Column) -> Column:
        fresh = lambda r, j: (j == 0) | (F.get(runs, (j - 1).cast("int"))["h"] != r["h"])
        return F.struct(F.filter(runs, fresh).alias("first"), F.filter(runs, lambda r, j: ~fresh(r, j)).alias("again"))

    inside = lambda code: (code >= 0) & (F.shiftright(code, 6) + code % 64 <= F.size("h"))
    runs = F.array_sort(F.transform(F.filter(F.array_distinct(F.flatten(F.transform("codes", around))), inside), run))
    both = base.dropDuplicates(["doc_id", "version"]).join(met, ["doc_id", "version"])
    cut = written(both.select("doc_id", "version", let(runs, parts).alias("x")).select("doc_id", "version", "x.first", "x.again"))
    flat = cut.select(F.struct("doc_id", "version").alias("d"), F.explode("first").alias("r")).select("d", "r.h", "r.lo", "r.hi")
    first = flat.groupBy("h").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 < d1").select("h", "d0")
    later = flat.join(first, "h").where("d > d0").select("d.doc_id", "d.version", "lo", "hi")
    again = cut.select("doc_id", "version", F.explode("again").alias("r")).select("doc_id", "version", "r.lo", "r.hi")
    return later.union(again).distinct()


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, counts: bool = False) -> DataFrame:
    """``docs`` without repeated runs; with ``counts`` also ``n_lines`` and ``n_removed``."""
    d, v, x = (unused(docs, c) for c in ("d", "v", "x"))
    runs = repeated_runs(docs, gram, window).groupBy(F.col("doc_id").alias(d), F.col("version").alias(v)).agg(F.collect_list(F.struct("lo", "hi")).alias(x))
    text = F.col("text").cast("string")
    joined = docs.join(runs, (F.col("doc_id") == F.col(d)) & (F.xxhash64(text) == F.col(v)), "left")

    def cleaned(lines: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(x, lambda r: F.sequence(r["lo"], r["hi"]))))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        kept = F.when(F.col(x).isNull(), text).otherwise(F.array_join(F.transform(left, lambda j: F.get(lines, j)), "\n"))
        return F.struct(kept.alias("text"), F.size(lines).cast("bigint").alias("n"), F.when(F.col(x).isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias("gone"))

    out = joined.withColumn(x, F.when(text.isNotNull(), let(_lines(text), cleaned)))
    none = lambda c: F.coalesce(F.col(x)[c], F.lit(0).cast("bigint"))
    extra = [none("n").alias("n_lines"), none("gone").alias("n_removed")] if counts else []
    return out.select(*(F.col(x)["text"].alias(c) if c == "text" else named(c) for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))), *extra)


def op8_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
b AS (SELECT doc_id, i, x, len(regexp_split_to_array(trim(x, ' ' || chr(9) || chr(13)), '\s+')) AS w FROM l WHERE trim(x, ' ' || chr(9) || chr(13)) <> ''),
n AS (SELECT doc_id, i, x, w, lead(x) OVER d AS x2, lead(x, 2) OVER d AS x3, lead(i) OVER d AS i2, lead(i, 2) OVER d AS i3, lead(w) OVER d AS w2
      FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i AS lo, i AS hi, 1 AS size, x AS k FROM n WHERE w > 50
      UNION ALL SELECT doc_id, i, i2, 2, x || chr(10) || x2 FROM n WHERE w + w2 > 50
      UNION ALL SELECT doc_id, i, i3, 3, x || chr(10) || x2 || chr(10) || x3 FROM n WHERE x3 IS NOT NULL),
v AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY size, k ORDER BY doc_id, lo) AS c FROM r),
z AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN v ON v.doc_id = l.doc_id AND l.i BETWEEN v.lo AND v.hi WHERE v.c > 1)
SELECT l.doc_id, count(*) AS n_lines, count(z.i) AS n_removed,
  sha256(coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (z.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN z ON z.doc_id = l.doc_id AND z.i = l.i GROUP BY l.doc_id
"""
