"""Stores that are rewritten in place, missing days, and streams that stop and start again."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from granary.operators import audit as au
from granary.operators import catalog, ranks
from granary.sources import stores
from granary.sources.scratch import fresh_dir
from granary.streaming import streams


def files(path):
    root = path.removeprefix("file://")
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_missing_days(spark):
    base = fresh_dir(spark, "days")
    end, schema = dt.date(2024, 3, 7), "n int, date date"
    assert stores.read_rollup(spark, base, "m", end, "weekly", schema).collect() == []
    with pytest.raises(FileNotFoundError):
        stores.read_rollup(spark, base, "m", end, "weekly")
    for n, day in enumerate((dt.date(2024, 3, 1), dt.date(2024, 3, 4), dt.date(2024, 2, 1))):
        stores.write_dated(spark.createDataFrame([(n,)], "n int"), base, "m", "daily", day)
    for schema in (None, "n int"):
        got = stores.read_rollup(spark, base, "m", end, "weekly", schema)
        assert rows(got) == [(0, dt.date(2024, 3, 1)), (1, dt.date(2024, 3, 4))] and got.columns == ["n", "date"]
    assert stores.read_rollup(spark, base, "m", dt.date(2024, 3, 3), "daily", "n int").count() == 0


def test_replace_leaves_others_and_an_open_reader(spark):
    base = fresh_dir(spark, "store")
    one = spark.createDataFrame([("a b=/", 1), ("c", 2), ("c", 3)], "k string, v int")
    stores.replace(one, base, "k")
    before, reader = files(base), stores.read_store(spark, base, "k")
    stores.replace(one.where("k = 'c'").withColumn("v", F.col("v") * 10), base, "k")
    assert [f for f in files(base) if "a%20" in f or "a b" in f] == [f for f in before if "a%20" in f or "a b" in f]
    assert rows(reader.select("k", "v")) == [("a b=/", 1), ("c", 2), ("c", 3)]  # the version it began with
    assert rows(stores.read_store(spark, base, "k").select("k", "v")) == [("a b=/", 1), ("c", 20), ("c", 30)]
    for _ in range(3):
        stores.replace(one.where("k = 'c'"), base, "k")
    assert sum("k=c" in f for f in files(base)) <= 2 * 2  # the last version and the one before
    assert stores.drop_partition(spark, base, "k", "a b=/") and not stores.drop_partition(spark, base, "k", "nowhere")
    assert rows(stores.read_store(spark, base, "k").select("k", "v")) == [("c", 2), ("c", 3)]
    empty = fresh_dir(spark, "store")
    assert stores.read_store(spark, empty, "k", schema=one.schema).collect() == []
    stores.replace(one.limit(0), empty, "k")
    assert stores.read_store(spark, empty, "k", schema=one.schema).collect() == []


@pytest.mark.parametrize("stop", [0, 1, 2])
def test_stop_between_renames(spark, monkeypatch, stop):
    """A writer dies before its first, second or third rename: a reader finds whole partitions, the next writer ends the work."""
    base = fresh_dir(spark, "store")
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    stores.replace(old, base, "k")
    real, left = stores.rename, [stop]

    def dies(*a):
        if left[0] == 0:
            raise RuntimeError("stopped")
        left[0] -= 1
        real(*a)

    monkeypatch.setattr(stores, "rename", dies)
    with pytest.raises(RuntimeError):
        stores.replace(old.withColumn("v", F.lit(2)), base, "k")
    monkeypatch.setattr(stores, "rename", real)
    after = {0: [("a", 1), ("b", 1)], 1: [("a", 1), ("b", 1)], 2: [("a", 2), ("b", 1)]}[stop]
    assert rows(stores.read_store(spark, base, "k").select("k", "v")) == after
    stores.recover(spark, base)
    assert rows(stores.read_store(spark, base, "k").select("k", "v")) == [("a", 1 if stop == 0 else 2), ("b", 1 if stop == 0 else 2)]
    assert not [n for n in stores.listed(spark, base) if n.startswith("_")]


def test_upsert_rewrites_touched_partitions_only(spark):
    base = fresh_dir(spark, "profiles")
    stored = spark.createDataFrame([("d1", "t", "c1", 1), ("d1", "t", "c2", 2), ("d2", "t", "c1", 3)], "db string, tbl string, column_name string, n int")
    stores.replace(stored, base, "db")
    before = files(base)
    new = spark.createDataFrame([("d1", "t", "c1", 10), ("d1", "t", "new", 11), ("d1", "u", "c", 12), ("d3", "t", "c", 13)], stored.schema)
    assert sorted(stores.upsert_stored(new, base)) == ["d1", "d3"]
    assert {f for f in before if "db=d2" in f} <= set(files(base))
    names = ["db", "tbl", "column_name", "n"]
    assert rows(stores.read_store(spark, base, "db").select(names)) == [("d1", "t", "c1", 10), ("d1", "t", "c2", 2), ("d1", "u", "c", 12), ("d2", "t", "c1", 3), ("d3", "t", "c", 13)]
    assert stores.upsert_stored(new.limit(0), base) == []


def test_status_rewrites_the_jobs_partition_only(spark):
    base, part = fresh_dir(spark, "history"), F.pmod("jobid", F.lit(4))
    t = spark.createDataFrame([(i, i % 8, "RUNNING") for i in range(40)], "id int, jobid int, status string")
    stores.replace(t.withColumn("jobs", part), base, "jobs")
    before = files(base)
    assert stores.set_stored_status(spark.createDataFrame([(5, "FAILED")], "jobid int, new_status string"), base, "jobs", part) == [1]
    assert {f for f in before if "jobs=1" not in f} <= set(files(base))
    assert rows(stores.read_store(spark, base, "jobs").select("id", "status")) == [(i, "FAILED" if i % 8 == 5 else "RUNNING") for i in range(40)]


def test_default_compaction_makes_few_files(spark):
    source, target = fresh_dir(spark, "many"), fresh_dir(spark, "few")
    spark.range(1000).repartition(50).write.parquet(source)
    assert stores.compact(spark, source, target) and len(files(target)) == 1 and spark.read.parquet(target).count() == 1000


def minutes(spark, *at):
    return spark.createDataFrame([(dt.datetime(2024, 1, d, h), k) for d, h, k in at], "ts timestamp, k string")


def test_rollup_counts_late_rows_and_survives_a_lost_commit(spark):
    inbox, target, mark = fresh_dir(spark, "inbox"), fresh_dir(spark, "today"), fresh_dir(spark, "mark")

    def take(*at):
        minutes(spark, *at).coalesce(1).write.mode("append").parquet(inbox)
        return streams.keep_rollup(streams.file_stream(spark, inbox, minutes(spark, *at).schema), target, mark, "ts", "k")

    assert [d["rows"] for d in take((1, 1, "a"), (1, 2, "a"), (1, 3, "b")) if d["rows"]] == [3]
    take((2, 5, "a"), (1, 23, "a"))  # a new day, and a row of the old one that is still open
    done = take((1, 9, "a"), (2, 6, "b"))  # the first day is closed now
    assert sum(d["late"] for d in done) == 1
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    expected = [(first, "a", 3), (first, "b", 1), (second, "a", 1), (second, "b", 1)]
    assert rows(streams.kept_rollup(spark, target, "k")) == expected
    commits = mark.removeprefix("file://") + "/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{commits}/{name}")
    streams.keep_rollup(streams.file_stream(spark, inbox, minutes(spark, (1, 1, "a")).schema), target, mark, "ts", "k")  # the last batch runs again
    assert rows(streams.kept_rollup(spark, target, "k")) == expected
    store = fresh_dir(spark, "days")
    assert streams.settle_rollup(spark, target, store, second, "k") == [first]
    assert rows(spark.read.parquet(store).select("date", "k", "count")) == expected[:2] and rows(streams.kept_rollup(spark, target, "k")) == expected[2:]
    assert streams.settle_rollup(spark, target, store, second, "k") == []


def test_records_that_cannot_be_read(spark):
    values = [b'{"typeName":"hive_table","qualifiedName":"d.t@c","at":"2024-01-01T00:00:00Z"}', b'{"typeName":"hive_table","qualifiedName":"d.t.col@c"}', b'{"typeName":"hive_db","qualifiedName":"d@c"}', b"", None, b"\xc3\x28", b"[1]", b"nonsense", b'{"typeName":"hive_table"}', b"{}", b'{"typeName":"hive_table","qualifiedName":"@c"}']
    records = spark.createDataFrame([(None, bytearray(v) if v is not None else None, "t", 0, i, None, 0) for i, v in enumerate(values)], streams.TOPIC_SCHEMA)
    got = {r.offset: (r.db, r.tbl, r.reason) for r in streams.read_changes(records).collect()}
    assert got == {
        0: ("d", "t", None), 1: ("d", "t", None), 2: (None, None, None), 3: (None, None, "empty"), 4: (None, None, "empty"), 5: (None, None, "not text"),
        6: (None, None, "not json"), 7: (None, None, "not json"), 8: (None, None, "no name"), 9: (None, None, "no name"), 10: (None, None, "no name"),
    }


@pytest.mark.parametrize("n", [0, 1, 3, 25, 1000])
def test_places_and_tiles(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("x"), "id").repartition(7)
    got = ranks.numbered(df, F.desc("x"), F.asc("id")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r.id for r in sorted(df.collect(), key=lambda r: (-r.x, r.id))]
    assert sorted(r.place for r in got) == list(range(1, n + 1)) and all(r.total == n for r in got)
    audit = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.col("id") % 5)).alias("_"), F.concat(F.lit("d/t"), "id").alias("resource"), F.lit("@table").alias("restype"), F.lit("select").alias("action"))
    tiles = au.activity_tiles(audit, 10)
    tiles.createOrReplaceTempView("tiles")
    assert spark.sql("SELECT * FROM (SELECT tile, ntile(10) OVER (ORDER BY count, htable) AS t FROM tiles) WHERE tile <> t").collect() == [] and tiles.count() == n


def test_inventory_reads_the_catalog(spark, sf):
    db = "granary_inventory_test"
    spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    spark.sql(f"CREATE DATABASE {db}")
    try:
        spark.read.parquet(f"{sf}/nation.parquet").write.saveAsTable(f"{db}.nation")
        spark.read.parquet(f"{sf}/nation.parquet").write.partitionBy("n_regionkey").saveAsTable(f"{db}.by_region")
        spark.sql(f"CREATE VIEW {db}.some AS SELECT 1 AS x")
        spark.sql(f"ANALYZE TABLE {db}.nation COMPUTE STATISTICS")
        got = {r.table: r for r in catalog.inventory(spark, [db]).collect()}
        assert set(got) == {"nation", "by_region", "some"} and all(abs((r.createTime - dt.date.today()).days) <= 1 for r in got.values())
        assert (got["nation"].numRows, got["nation"].numPartitions, got["by_region"].numPartitions) == (25, 0, 5) and got["nation"]["size"] > 0 and got["by_region"].numRows is None
        assert len(catalog.inventory(spark, [db, "default"]).collect()) >= 3
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
