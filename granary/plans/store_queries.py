"""Queries of sinks, dated stores, metric views and streams: each writes in a fresh folder and returns what it reads back."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import audit as au
from granary.operators import catalog as ca
from granary.sources import stores
from granary.sources.scratch import fresh_dir, written
from granary.streaming import streams

from .registry import query
from .table_queries import _HTABLE, _rollup_sql

_DATE = dt.date(2024, 1, 31)
_LAST = "(SELECT max(CAST(evttime AS DATE)) FROM audit)"


def _last_day(audit: DataFrame) -> dt.date:
    return audit.agg(F.max(F.to_date("evttime")).alias("d")).first()["d"]


@query("audit_scan_json", "audit", oracle=f"SELECT resource, restype AS resType, access, action, result, requser AS reqUser FROM audit WHERE CAST(evttime AS DATE) > {_LAST} - 7")
def _scan_json(audit: DataFrame) -> DataFrame:
    """The audit table as dated JSON folders, of which the last week is read."""
    spark, base = audit.sparkSession, fresh_dir(audit.sparkSession, "audit")
    end = _last_day(audit)
    rows = audit.select("resource", F.col("restype").alias("resType"), "access", "action", "result", F.col("requser").alias("reqUser"), F.date_format("evttime", "yyyyMMdd").alias("day"))
    rows.write.partitionBy("day").json(base)
    for day in stores.days_of(end, "weekly"):  # the job's folders are bare dates
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/day={day:%Y%m%d}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            fs.rename(path, jvm.org.apache.hadoop.fs.Path(f"{base}/{day:%Y%m%d}"))
    return stores.read_audit(spark, base, end, "weekly")


def _daily(audit: DataFrame) -> DataFrame:
    named = au.with_table_name(audit).where("htable is not null").withColumn("date", F.to_date("evttime"))
    return named.groupBy("date", "htable").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("action") == "select").alias("selects"))


_DAILY = f"SELECT CAST(evttime AS DATE) AS date, {_HTABLE} AS htable, count(*) AS count, count(CASE WHEN action = 'select' THEN 1 END) AS selects FROM audit GROUP BY 1, 2 HAVING htable IS NOT NULL"


_DAILY_SCHEMA = "htable string, count bigint, selects bigint"


@query("rollup_scan_dates", "audit", oracle=f"SELECT * FROM ({_DAILY}) WHERE date > {_LAST} - 7")
def _scan_dates(audit: DataFrame) -> DataFrame:
    base = fresh_dir(audit.sparkSession, "rollup")
    stores.write_dated(_daily(audit), base, "tables", "daily")
    return stores.read_rollup(audit.sparkSession, base, "tables", _last_day(audit), "weekly").select("date", "htable", "count", "selects")


@query("rollup_scan_gaps", "audit", oracle=f"SELECT * FROM ({_DAILY}) WHERE date > {_LAST} - 7 AND date NOT IN ({_LAST} - 2, {_LAST} - 5)")
def _scan_gaps(audit: DataFrame) -> DataFrame:
    """A week of which two days were never rolled up, beside a metric that has no tree at all."""
    spark, base, end = audit.sparkSession, fresh_dir(audit.sparkSession, "rollup"), _last_day(audit)
    gone = [end - dt.timedelta(days=n) for n in (2, 5)]
    stores.write_dated(_daily(audit).where(~F.col("date").isin(gone)), base, "tables", "daily")
    none = stores.read_rollup(spark, base, "absent", end, "weekly", _DAILY_SCHEMA)
    return stores.read_rollup(spark, base, "tables", end, "weekly", _DAILY_SCHEMA).unionByName(none).select("date", "htable", "count", "selects")


@query("sink_dated_partition", "audit", oracle=_DAILY)
def _dated(audit: DataFrame) -> DataFrame:
    """Written, one day written again, and read: rerunning a day changes nothing, other days stay."""
    base, rows = fresh_dir(audit.sparkSession, "dated"), _daily(audit)
    path = stores.write_dated(rows, base, "tables", "daily")
    stores.write_dated(rows.where(F.col("date") == _last_day(audit)), base, "tables", "daily")
    return audit.sparkSession.read.parquet(path).select("date", "htable", "count", "selects")


@query("rollup_top_selected", "audit", oracle=f"SELECT htable, CAST(sum(selects) AS BIGINT) AS selects FROM ({_DAILY}) WHERE date > {_LAST} - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _top_selected(audit: DataFrame) -> DataFrame:
    base = fresh_dir(audit.sparkSession, "top")
    stores.write_dated(_daily(audit), base, "tables", "daily")
    month = stores.read_rollup(audit.sparkSession, base, "tables", _last_day(audit), "monthly")
    return month.groupBy("htable").agg(F.sum("selects").alias("selects")).orderBy(F.desc("selects"), "htable").limit(5)


@query("sink_daily_and_snapshot", "table_catalog", oracle="SELECT 'daily' AS kind, table_name, size, DATE '2024-01-31' AS date FROM table_catalog UNION ALL SELECT 'snapshot', table_name, size, NULL FROM table_catalog")
def _two_sinks(t: DataFrame) -> DataFrame:
    daily, snapshot = stores.write_daily_and_snapshot(t.select("table_name", "size"), fresh_dir(t.sparkSession, "catalog"), "catalog", _DATE)
    read = t.sparkSession.read.parquet
    return read(daily).select(F.lit("daily").alias("kind"), "table_name", "size", "date").unionByName(read(snapshot).select(F.lit("snapshot").alias("kind"), "table_name", "size", F.lit(None).cast("date").alias("date")))


_SENS_COLUMNS = ("database", "table_name", "column_name", "label", "percentmatch", "status")


@query("sink_table_partition", "sensitivity", oracle="SELECT database, table_name, column_name, CASE WHEN database = 'db1' AND table_name = 't7' THEN 'edited' ELSE label END AS label, percentmatch, status FROM sensitivity")
def _table_partition(t: DataFrame) -> DataFrame:
    """One partition is overwritten with edits; the others survive."""
    path = fresh_dir(t.sparkSession, "sensitivity")
    stores.write_partitions(t, path, "database", "table_name")
    stores.write_partitions(t.where("database = 'db1' and table_name = 't7'").withColumn("label", F.lit("edited")), path, "database", "table_name")
    return t.sparkSession.read.parquet(path).select(*_SENS_COLUMNS)


@query("compact_snapshot", "sensitivity", oracle="SELECT database, table_name, column_name, label, percentmatch, status FROM sensitivity")
def _compact(t: DataFrame) -> DataFrame:
    source, target = fresh_dir(t.sparkSession, "store"), fresh_dir(t.sparkSession, "snapshot")
    stores.write_partitions(t, source, "database")
    stores.compact(t.sparkSession, source, target)
    return t.sparkSession.read.parquet(target).select(*_SENS_COLUMNS)


@query("partition_row_count", "sensitivity", oracle="SELECT database, count(*) AS n FROM sensitivity GROUP BY 1")
def _partition_count(t: DataFrame) -> DataFrame:
    path = stores.write_partitions(t, fresh_dir(t.sparkSession, "counted"), "database")
    return t.sparkSession.read.parquet(path).groupBy("database").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_mapping_replace", "dataset_asset", oracle="SELECT datasetname, count(assetid) AS assets FROM dataset_asset WHERE datasetname <> 'ds1' OR assetid LIKE '%2' GROUP BY 1")
def _replace(t: DataFrame) -> DataFrame:
    """The members of one dataset are replaced in the store."""
    spark, base = t.sparkSession, fresh_dir(t.sparkSession, "datasets")
    stores.replace(t, base, "datasetname")
    stores.replace(t.where("datasetname = 'ds1' and assetid like '%2'"), base, "datasetname")
    return stores.read_store(spark, base, "datasetname").groupBy("datasetname").agg(F.count("assetid").alias("assets"))


@query("dataset_mapping_delete", "dataset_asset", oracle="SELECT datasetname, assetid, priority FROM dataset_asset WHERE datasetname <> 'ds2'")
def _delete(t: DataFrame) -> DataFrame:
    """One dataset is taken out of the store."""
    spark, base = t.sparkSession, fresh_dir(t.sparkSession, "members")
    stores.replace(t, base, "datasetname")
    stores.drop_partition(spark, base, "datasetname", "ds2")
    return stores.read_store(spark, base, "datasetname").select("datasetname", "assetid", "priority")


@query("profile_upsert", "table_catalog", oracle="""SELECT db, substr(outputformat, 1, 5) AS tbl, table_name AS column_name, CASE WHEN numpartitions % 2 = 0 OR NOT (db <> 'db3') THEN numrows + 1 ELSE numrows END AS non_null_count FROM table_catalog
WHERE (db <> 'db3' AND numpartitions % 3 <> 0) OR (NOT EXISTS (SELECT 1 FROM table_catalog s WHERE s.db <> 'db3' AND s.numpartitions % 3 <> 0 AND s.db = table_catalog.db AND substr(s.outputformat, 1, 5) = substr(table_catalog.outputformat, 1, 5)) AND (numpartitions % 2 = 0 OR db = 'db3'))""")
def _upsert(t: DataFrame) -> DataFrame:
    """Stored profiles of some tables meet new ones: known columns change, unknown tables come in. The store is written, changed and read."""
    spark, path = t.sparkSession, fresh_dir(t.sparkSession, "profiles")
    base = t.select("db", F.substring("outputformat", 1, 5).alias("tbl"), F.col("table_name").alias("column_name"), F.col("numrows").alias("non_null_count"), "numpartitions")
    stores.replace(base.where("db <> 'db3' and numpartitions % 3 <> 0").drop("numpartitions"), path, "db")
    stores.upsert_stored(base.where("numpartitions % 2 = 0 or db = 'db3'").withColumn("non_null_count", F.col("non_null_count") + 1).drop("numpartitions"), path)
    return stores.read_store(spark, path, "db").select("db", "tbl", "column_name", "non_null_count")


query("json_rows", "region", oracle="SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")(lambda t: t.select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value")))


@query("history_append", "dataset_asset", "jobs", oracle="SELECT j.id AS jobid, d.assetid, 'STARTED' AS status FROM dataset_asset d, (SELECT * FROM jobs WHERE id IN (SELECT min(id) FROM jobs UNION SELECT max(id) FROM jobs)) j")
def _append(d: DataFrame, j: DataFrame) -> DataFrame:
    """Two jobs start one after the other; each appends a row for every asset."""
    path, spark = fresh_dir(d.sparkSession, "history"), d.sparkSession
    for end in (F.min, F.max):
        job = j.agg(end("id").alias("jobid"))
        d.select("assetid").crossJoin(F.broadcast(job)).select("jobid", "assetid", F.lit("STARTED").alias("status")).write.mode("append").parquet(path)  # one row
    return spark.read.parquet(path)


@query("history_status_update", "run_history", oracle="SELECT id, jobid, CASE WHEN jobid % 5 = 0 THEN 'SUCCESS' ELSE status END AS status FROM run_history")
def _status(t: DataFrame) -> DataFrame:
    """A stored history, dealt by job, in which every fifth job ends: of 25 partitions 5 are rewritten."""
    spark, base, part = t.sparkSession, fresh_dir(t.sparkSession, "history"), F.pmod("jobid", F.lit(25))
    stores.replace(t.withColumn("jobs", part), base, "jobs")
    stores.set_stored_status(t.where("jobid % 5 = 0").select("jobid").distinct().withColumn("new_status", F.lit("SUCCESS")), base, "jobs", part)
    return stores.read_store(spark, base, "jobs").select("id", "jobid", "status")


@query("metric_view_sql", "table_catalog", oracle="SELECT db, count(*) AS n, max(size) AS largest FROM table_catalog GROUP BY db")
def _view(t: DataFrame) -> DataFrame:
    spark, path, name = t.sparkSession, fresh_dir(t.sparkSession, "metric"), f"metric_{uuid.uuid4().hex}"
    t.write.parquet(path)
    stores.open_view(spark, path, name)
    try:
        return written(spark.sql(f"SELECT db, count(*) AS n, max(size) AS largest FROM {name} GROUP BY db"))
    finally:
        stores.close_view(spark, name)


@query("metric_cache_refresh", "table_catalog", oracle="SELECT 'after' AS moment, count(*) AS n FROM table_catalog UNION ALL SELECT 'before', count(*) FROM table_catalog WHERE db = 'db0'")
def _refresh(t: DataFrame) -> DataFrame:
    """Read, overwritten, refreshed, and read again."""
    spark, path, name = t.sparkSession, fresh_dir(t.sparkSession, "refresh"), f"metric_{uuid.uuid4().hex}"
    t.where("db = 'db0'").write.parquet(path)
    before = stores.open_view(spark, path, name).count()
    t.write.mode("overwrite").parquet(path)
    after = stores.refresh_view(spark, path, name).count()
    stores.close_view(spark, name)
    return spark.createDataFrame([("before", before), ("after", after)], "moment string, n bigint")


@query("catalog_inventory", "part", "supplier", oracle="SELECT 'part' AS \"table\", count(DISTINCT p_brand) AS numPartitions, 'parquet' AS inputFormat FROM part UNION ALL SELECT 'supplier', 0, 'parquet'")
def _inventory(part: DataFrame, supplier: DataFrame) -> DataFrame:
    """Two tables are saved in a database of their own and crawled; the database goes afterwards."""
    spark, db = part.sparkSession, f"granary_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{fresh_dir(spark, 'catalog')}'")
    try:
        part.write.partitionBy("p_brand").saveAsTable(f"{db}.part")
        supplier.write.saveAsTable(f"{db}.supplier")
        return written(ca.inventory(spark, [db]).select("table", "numPartitions", F.lower("inputFormat").alias("inputFormat")))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


# --- streams
def _events_folder(rows: DataFrame, by_time: bool, key: str = "event_id") -> tuple[str, T.StructType]:
    """Rows in five files, in order of time or interleaved, with times as timestamps."""
    path = fresh_dir(rows.sparkSession, "events")
    rows = rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if isinstance(f.dataType, T.TimestampNTZType)})
    n = F.floor(F.col(key) * 5 / (rows.agg(F.max(key)).first()[0] + 1)) if by_time else F.col(key) % 5
    for i in range(5):  # one after the other, as files come in
        rows.where(n == i).coalesce(1).write.mode("append").parquet(path)
    return path, rows.schema


def _messages(events: DataFrame) -> DataFrame:
    """Events as records of a topic: table and database messages, and four kinds that can't be read."""
    kind = F.when(F.col("event_type").isin("view", "click"), "hive_table").otherwise("hive_db")
    name = F.format_string("db%d.t%d@cl", F.col("user_id") % 3, "user_id")
    whole = F.to_json(F.struct(kind.alias("typeName"), name.alias("qualifiedName"), F.col("ts").alias("at")))
    nameless = F.to_json(F.struct(F.lit("hive_table").alias("typeName"), F.lit("t").alias("qualifiedName")))
    odd = F.col("event_id") % 4
    broken = F.when(odd == 0, F.lit("{broken").cast("binary")).when(odd == 1, nameless.cast("binary")).when(odd == 2, F.unhex(F.lit("C328")))
    value = F.when(F.col("event_type") == "error", broken).otherwise(whole.cast("binary"))
    return events.select(F.lit(None).cast("binary").alias("key"), value.alias("value"), F.lit("changes").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"))


def _change_stores(events: DataFrame) -> tuple[str, str]:
    spark = events.sparkSession
    path, schema = _events_folder(_messages(events), True, "offset")
    tables, unreadable = fresh_dir(spark, "changes"), fresh_dir(spark, "unreadable")
    streams.drain_changes(streams.file_stream(spark, path, schema), tables, unreadable, fresh_dir(spark, "mark"))
    return tables, unreadable


@query("stream_table_changes", "events", oracle="SELECT 'db' || CAST(user_id % 3 AS STRING) AS db, 't' || CAST(user_id AS STRING) AS tbl, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2")
def _changes(events: DataFrame) -> DataFrame:
    """Changed tables of a topic, some records of which are unreadable."""
    tables, _ = _change_stores(events)
    return events.sparkSession.read.parquet(tables).groupBy("db", "tbl").agg(F.count(F.lit(1)).alias("n"))


@query("stream_unreadable_records", "events", oracle="SELECT event_id AS \"offset\", ['not json', 'no name', 'not text', 'empty'][event_id % 4 + 1] AS reason, [7, length('{\"typeName\":\"hive_table\",\"qualifiedName\":\"t\"}'), 2, NULL][event_id % 4 + 1] AS bytes FROM events WHERE event_type = 'error'")
def _unreadable(events: DataFrame) -> DataFrame:
    """What the same batches could not read, as it came."""
    _, unreadable = _change_stores(events)
    return events.sparkSession.read.parquet(unreadable).select("offset", "reason", F.length("value").alias("bytes"))


@query("stream_microbatch_dedupe", "events", oracle="SELECT DISTINCT user_id, event_type FROM events")
def _dedupe(events: DataFrame) -> DataFrame:
    """Duplicates go within a batch; the set over all batches is that of the table."""
    spark = events.sparkSession
    path, schema = _events_folder(events, False)
    target = fresh_dir(spark, "deduped")
    streams.drain(streams.file_stream(spark, path, schema).select("user_id", "event_type"), target, fresh_dir(spark, "mark"), ["user_id", "event_type"])
    return spark.read.parquet(target).select("user_id", "event_type").distinct()


@query("stream_rate_limit", "events", oracle="WITH e AS (SELECT CAST(floor(event_id * 5 / (max(event_id) OVER () + 1)) AS BIGINT) AS batch FROM events) SELECT batch, count(*) AS taken, count(*) AS stored FROM e GROUP BY 1")
def _rate(events: DataFrame) -> DataFrame:
    """Rows that each trigger of a stream took which may read one file at a time, by its progress event and by what it stored."""
    spark = events.sparkSession
    path, schema = _events_folder(events, True)
    target = fresh_dir(spark, "limited")
    done = streams.drain(streams.file_stream(spark, path, schema, 1).select("event_id"), target, fresh_dir(spark, "mark"))
    taken = spark.createDataFrame([(d["batch"], d["rows"]) for d in done], "batch bigint, taken bigint")
    return taken.join(spark.read.parquet(target).groupBy("batch").agg(F.count(F.lit(1)).alias("stored")), "batch", "left").select("batch", "taken", "stored")


@query("stream_same_day_rollup", "events", oracle="SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def _same_day(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    path, schema = _events_folder(events, True)
    target = fresh_dir(spark, "today")
    streams.keep_rollup(streams.file_stream(spark, path, schema), target, fresh_dir(spark, "mark"), "ts", "event_type")
    return streams.kept_rollup(spark, target, "event_type").withColumnRenamed("date", "day")


@query("stream_audit_rollup", "audit", oracle=_rollup_sql("CAST(evttime AS DATE) AS date, split_part(h, '.', 1) AS db, split_part(h, '.', 2) AS tbl", f"SELECT {_HTABLE} AS h, * FROM audit", "h IS NOT NULL"))
def _audit_stream(audit: DataFrame) -> DataFrame:
    """The roll-up of audit rows by table, kept in its days by a stream that is stopped after three of five files and started again;
    the first week is then settled in the daily store, and both are read."""
    spark = audit.sparkSession
    path, schema = _events_folder(audit, True)
    inbox, target, store, mark = fresh_dir(spark, "inbox"), fresh_dir(spark, "today"), fresh_dir(spark, "days"), fresh_dir(spark, "mark")
    keys, ends = ("db", "tbl", "dim", "value"), audit.agg(F.floor(F.max("event_id") * 3 / 5).alias("half"), F.min(F.to_date("evttime")).alias("day")).first()
    for part in ("event_id <= {0}", "event_id > {0}"):
        spark.read.schema(schema).parquet(path).where(part.format(ends.half)).coalesce(1).write.mode("append").parquet(inbox)
        streams.keep_rollup(streams.audit_rollup_rows(streams.file_stream(spark, inbox, schema)), target, mark, "evttime", *keys)
    streams.settle_rollup(spark, target, store, ends.day + dt.timedelta(days=7), *keys)
    return spark.read.parquet(store).unionByName(streams.kept_rollup(spark, target, *keys)).select("date", *keys, "count")


@query("catch_up_run", "events", oracle="SELECT event_id % 2 = 1 AS late, count(*) AS n FROM events GROUP BY 1")
def _catch_up(events: DataFrame) -> DataFrame:
    """Half of the events, a run, the other half, and a second run that takes only those."""
    spark, path, target, mark = events.sparkSession, fresh_dir(events.sparkSession, "inbox"), fresh_dir(events.sparkSession, "caught"), fresh_dir(events.sparkSession, "mark")
    rows = events.select("event_id")
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(path)
        streams.drain(streams.file_stream(spark, path, rows.schema, 100), target, mark)
    return spark.read.parquet(target).groupBy((F.col("event_id") % 2 == 1).alias("late")).agg(F.count(F.lit(1)).alias("n"))
