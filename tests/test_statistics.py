"""The profile in two scans, mergeable states, and labels of wide tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import mergeable as mg
from granary.operators import sensitive, stats
from granary.sources.scratch import fresh_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_of_a_wide_table_take_one_scan(spark):
    """500 columns and all labels, of which every value is known."""
    rnd = random.Random(5)
    values = ["a@b.com", "10.0.0.1", "4111111111111111", None, "", "x"]
    rows = [tuple(rnd.choice(values) for _ in range(500)) for _ in range(60)]
    path = fresh_dir(spark, "wide")
    spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(500))).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    out = sensitive.label_counts(df, df.columns, sensitive.PATTERNS)
    assert plan_of(out).count("FileScan") == 1
    got = {(r.column_name, r.label): (r.matches, r.nulls, r.total) for r in out.collect()}
    assert len(got) == 500 * len(sensitive.PATTERNS)
    for i in (0, 250, 499):
        column = [r[i] for r in rows]
        for label, v in (("email", "a@b.com"), ("ipaddress", "10.0.0.1"), ("creditcard", "4111111111111111")):
            assert got[f"c{i}", label] == (column.count(v), column.count(None), 60)


def test_labels_of_nothing(spark):
    empty = spark.createDataFrame([], "`a.b` string, n int")
    got = sensitive.label_counts(empty, ["a.b", "n"], {"x": ["x"], "y": ["y"]}).collect()
    assert sorted(map(tuple, got)) == [(c, k, 0, 0, 0) for c in ("a.b", "n") for k in ("x", "y")]


def test_profile_scans_twice(spark, sf, monkeypatch):
    scans, df = [], spark.read.parquet(f"{sf}/lineitem.parquet")
    real = stats.written

    def counted(first):
        scans.append(plan_of(first).count("lineitem.parquet"))
        return real(first)

    monkeypatch.setattr(stats, "written", counted)
    out = stats.profile(df)
    assert scans == [1]
    assert plan_of(out).count("lineitem.parquet") == 1 and "Generate" not in plan_of(out).split("lineitem.parquet")[0].rsplit("HashAggregate", 1)[-1]
    rows = {(r.column_name, r.metric): r.value for r in out.collect()}
    assert rows["l_returnflag", "item R"] == df.where("l_returnflag = 'R'").count() and rows["l_linenumber", "item 1"] == df.where("l_linenumber = 1").count()


def test_profile_of_odd_columns(spark):
    schema = "`a b` double, `it's` string, `x.y` int, s struct<k:int>, l array<int>, d date, t timestamp, b binary"
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "q'", 1, (1,), [1], dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), bytearray(b"x")), (nan, None, None, None, None, None, None, None), (3.0, "q'", 1, None, None, None, None, None)], schema)
    got = {(r.column_name, r.metric): r.value for r in stats.profile(df).collect()}
    assert got["it's", "item q'"] == 2 and got["x.y", "item 1"] == 2 and got["a b", "bin 1.0"] == 1 and got["a b", "bin 2.8"] == 1 and got["d", "null_count"] == 2
    assert not [c for c, _ in got if c in ("s", "l")]


def test_frequent_items_miss_none(spark):
    """One item just at the support among very many that occur once."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 20 == 0, "often").otherwise(F.col("id").cast("string")).alias("v"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("n"))
    assert sorted(map(tuple, stats.frequent_items(rows, ["v", "k", "n"], 0.05).collect())) == [("k", "1", 20_000), ("v", "often", 1000)]
    assert stats.frequent_items(rows.limit(0), ["v"], 0.05).collect() == []
    assert sorted(map(tuple, stats.exact_counts(spark.createDataFrame([("a",), ("a",), (None,)], "v string"), ["v"]).collect())) == [("v", "a", 2)]


def test_states_merge_to_the_whole(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumn("flag", F.col("o_orderkey") % 3 == 0)
    parts = mg.states(df.withColumn("day", F.col("o_custkey") % 5), "day")
    apart = {(r.column_name, r.metric): r.value for r in mg.finished(mg.merged(parts)).collect()}
    whole = {(r.column_name, r.metric): r.value for r in mg.finished(mg.states(df)).collect()}
    assert apart.keys() == whole.keys() and ("flag", "true_count") in whole and ("o_orderpriority", "mean_length") in whole
    for k, v in whole.items():
        bound = 0.05 if k[1].startswith(("q", "approx")) else 1e-9
        assert apart[k] == pytest.approx(v, rel=bound), k
    twice = mg.merged(parts.where("day < 2")).unionByName(mg.merged(parts.where("day >= 2")))  # in any order and depth
    again = {(r.column_name, r.metric): r.value for r in mg.finished(mg.merged(twice)).collect()}
    for k, v in apart.items():  # sketches may answer differently by order, within their bounds
        assert again[k] == pytest.approx(v, rel=0.05 if k[1].startswith(("q", "approx")) else 1e-9), k
    by_day = mg.finished(parts, "day").where("metric = 'non_null_count' and column_name = 'o_orderkey'")
    assert sorted((r.day, r.value) for r in by_day.collect()) == sorted((r[0], float(r[1])) for r in df.groupBy(F.col("o_custkey") % 5).count().collect())
    items = {(r.column_name, r["item"]): r["count"] for r in mg.frequent(mg.merged(parts)).collect()}
    assert items["flag", "true"] == whole["flag", "true_count"]


def test_states_of_nothing_and_of_nulls(spark):
    schema = "n int, s string, b boolean, day int"
    none = spark.createDataFrame([], schema)
    assert mg.states(none, "day").count() == 0
    nulls = mg.states(spark.createDataFrame([(None, None, None, 1), (None, None, None, 2), (float("nan") and 5, "x", True, 3)], schema), "day")
    got = {(r.column_name, r.metric): r.value for r in mg.finished(mg.merged(nulls.where("day < 3"))).collect()}
    assert got["n", "null_count"] == 2 and got["n", "mean"] is None and got["n", "q50"] is None and got["s", "max_length"] == 0 and got["b", "true_count"] == 0
    all_of = {(r.column_name, r.metric): r.value for r in mg.finished(mg.merged(nulls)).collect()}
    assert all_of["n", "mean"] == 5 and all_of["n", "stddev"] is None and all_of["n", "q100"] == 5 and all_of["b", "true_count"] == 1


def test_moments_far_from_zero(spark):
    df = spark.range(1000).select((F.col("id") % 7 + 1e6).alias("v"), (F.col("id") % 4).alias("day"))
    got = {r.metric: r.value for r in mg.finished(mg.merged(mg.states(df, "day"))).where("column_name = 'v'").collect()}
    exact = df.agg(F.avg("v"), F.stddev_samp("v")).first()
    assert got["mean"] == pytest.approx(exact[0], rel=1e-12) and got["stddev"] == pytest.approx(exact[1], rel=1e-4)


def test_registered_aggregator_and_folding(spark):
    mg.register("energy", mg.Aggregator(("numeric",), "double", lambda c: F.sum(c.cast("double") * c), lambda s: F.sum(s), lambda s: [("energy", s)]))
    try:
        df = spark.range(10).select(F.col("id").alias("v"), (F.col("id") % 3).alias("day"), F.lit("x").alias("s"))
        got = {(r.column_name, r.metric): r.value for r in mg.finished(mg.merged(mg.states(df, "day"))).collect()}
        assert got["v", "energy"] == 285 and ("s", "energy") not in got
    finally:
        del mg.AGGREGATORS["energy"]
    longest = mg.Folding("string", lambda: "", lambda s, v: max([s, *(x for x in v.to_pylist() if x)], key=lambda x: (len(x), x)), lambda a, b: max(a, b, key=lambda x: (len(x), x)), lambda s: len(s) or None)
    words = spark.range(5000).select(F.repeat(F.lit("a"), (F.col("id") % 97).cast("int")).alias("w"), F.lit(None).cast("string").alias("n")).repartition(40)
    merged = mg.merged_folds(mg.folded(words, ["w", "n"], longest), longest, fan=3)
    assert sorted(map(tuple, mg.finished_folds(merged, longest, "longest").collect()), key=str) == [("n", "longest", None), ("w", "longest", 96.0)]


def test_checks_of_profiles_stay_narrow(spark):
    """Distinct values of several columns without a row of all columns for each; ranks without a lookup in a map for each row."""
    from granary.plans import table_queries as tq

    nan = float("nan")
    t = spark.createDataFrame([(1, 0.0, "a"), (2, -0.0, None), (2, nan, "b"), (None, nan, "b"), (3, None, "b")], "a long, `b` double, c string")
    found = stats.exact_distinct(t, ["a", "b", "c"])
    assert sorted(map(tuple, found.collect())) == [("a", 3), ("b", 2), ("c", 2)]
    marks = spark.createDataFrame([("a", "q0", 1.0), ("a", "q50", 2.0), ("b", "q0", 5.0), ("b", "q50", None)], "column_name string, metric string, value double")
    ranks = tq._ranks_hold(t, marks, ["a", "b"], (0.0, 0.5), 0.01)
    assert sorted(r.metric for r in ranks.where("column_name = 'a' and within_bound").collect()) == ["q0", "q50"]
    for df, word in ((found, "Expand"), (ranks, "element_at"), (ranks, "map_from_entries")):
        assert word not in df._jdf.queryExecution().toString()
