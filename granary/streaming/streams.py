"""Structured Streaming jobs: catalog changes, deduplicated micro-batches, rate limits, same-day roll-ups and catch-up runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.expr import split_qualified
from granary.operators.audit import DIMENSIONS, dimension_rows, with_table_name
from granary.sources.stores import remove

CHANGE_SCHEMA = T.StructType([T.StructField("typeName", T.StringType()), T.StructField("qualifiedName", T.StringType()), T.StructField("at", T.TimestampType())])


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream; ``files_per_batch`` limits the rate at the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Records of a topic as the source gives them.
TOPIC_SCHEMA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_batch: int = 1000) -> DataFrame:
    """Records of a topic (``TOPIC_SCHEMA``), at most so many a batch."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_batch).load()


def read_changes(records: DataFrame) -> DataFrame:
    """Records of a topic with (db, tbl, at) of the changed table, or with ``reason`` why they can't be read. Readable messages
    of other entities have neither.

    Reasons: ``empty`` (no value), ``not text`` (no UTF-8), ``not json`` (no JSON object), ``no name`` (a table without ``db.table@cluster``)."""
    value = F.col("value")
    text = F.when(F.is_valid_utf8(value.cast("string")), value.cast("string"))
    parsed = records.withColumn("_m", F.from_json(text, T.StructType([*CHANGE_SCHEMA.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    db, tbl, _ = split_qualified(F.col("_m.qualifiedName"))
    is_table = F.coalesce(F.col("_m.typeName") == "hive_table", F.lit(False))
    named = F.coalesce(F.col("_m.qualifiedName").rlike(r"^[^.@]+\.[^.@]+(\.[^@]*)?@."), F.lit(False))
    reason = (
        F.when(value.isNull() | (F.length(value) == 0), "empty").when(text.isNull(), "not text").when(F.col("_m._bad").isNotNull() | ~F.ltrim(text).startswith("{"), "not json")
        .when((is_table | F.col("_m.typeName").isNull()) & ~named, "no name")
    )
    good = reason.isNull() & is_table
    return parsed.select(*records.columns, *(F.when(good, c).alias(n) for c, n in ((db, "db"), (tbl, "tbl"), (F.col("_m.at"), "at"))), reason.alias("reason"))


def _run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> list[dict]:
    """Takes all that is new since the last run with this checkpoint, batch by batch; (batch, rows, late) of each batch of this run: rows taken
    from the source, and groups that came too late for a watermark. Spark keeps the last 100 batches' figures unless told otherwise."""
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(sink).start()
    try:
        q.awaitTermination()
        done = q.recentProgress
    finally:
        q.stop()
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "late": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])} for p in done]


def drain(stream: DataFrame, target: str, checkpoint: str, dedupe: list[str] | None = None) -> list[dict]:
    """Takes what is new into parquet; duplicates within a batch go. Returns each batch's figures.

    A batch is written under its number and overwrites itself when it is run again."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(dedupe) if dedupe else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _run(stream, checkpoint, sink)


def drain_changes(records: DataFrame, tables: str, unreadable: str, checkpoint: str) -> list[dict]:
    """A stream of topic records into two stores: changed tables (db, tbl, at, partition, offset) and unreadable records as they came, with the reason.

    Both are written under the number of the batch, from one reading of it; a batch that is run again overwrites itself in both, so each record
    stands in one of them once."""

    def sink(batch: DataFrame, number: int) -> None:
        found = read_changes(batch).persist()
        try:
            found.where("db is not null").select("db", "tbl", "at", "partition", "offset").write.mode("overwrite").parquet(f"{tables}/batch={number}")
            found.where("reason is not null").drop("db", "tbl", "at").write.mode("overwrite").parquet(f"{unreadable}/batch={number}")
        finally:
            found.unpersist()

    return _run(records, checkpoint, sink)


def daily_rollup(stream: DataFrame, time: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """(day, keys, count) over a watermarked stream. Update output has the groups that changed, with their counts so far; append output leaves out the open day."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("count")).select(F.to_date("w.start").alias("day"), *keys, "count")


def keep_rollup(stream: DataFrame, target: str, checkpoint: str, time: str, *keys: str, late: str = "10 minutes") -> list[dict]:
    """A same-day roll-up, kept up to date in the partitions of its days: ``{target}/date=…/batch=…``.

    Each batch writes the groups that it changed, with their counts so far, under its own number; no stored row is read or rewritten, and a batch that is
    run again overwrites itself. State holds the open days only: with the watermark a day is closed, and rows that come for it after that are
    dropped and counted as ``late`` in the figures returned."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.withColumnRenamed("day", "date").withColumn("batch", F.lit(number))
        rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(target)

    return _run(daily_rollup(stream, time, *keys, late=late), checkpoint, sink, "update")


def kept_rollup(spark: SparkSession, target: str, *keys: str, days: list[dt.date] | None = None) -> DataFrame:
    """(date, keys, count) of a kept roll-up: of each group what its last batch says. ``days`` prunes partitions."""
    rows = spark.read.parquet(target)
    rows = rows if days is None else rows.where(F.col("date").isin(days))
    return rows.groupBy("date", *keys).agg(F.max_by("count", "batch").alias("count"))


def settle_rollup(spark: SparkSession, target: str, store: str, before: dt.date, *keys: str) -> list[dt.date]:
    """Moves the days before a date, which must be closed, from a kept roll-up to ``{store}/date=…`` as one batch each, and returns them.

    A day is dropped from ``target`` only after it stands in the store; a stop in between leaves it in both, and the next call writes it again."""
    days = sorted(r.date for r in spark.read.parquet(target).where(F.col("date") < F.lit(before)).select("date").distinct().collect())
    if days:
        kept_rollup(spark, target, *keys, days=days).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(store)
        for day in days:
            remove(spark, f"{target}/date={day}")
    return days


def audit_rollup_rows(audit: DataFrame, time: str = "evttime") -> DataFrame:
    """A stream (or table) of audit rows as (time, db, tbl, dim, value), of which a count by day is the daily roll-up."""
    named = with_table_name(audit).where("htable is not null")
    parts = F.split("htable", r"\.")
    return dimension_rows(named.select(time, parts[0].alias("db"), parts[1].alias("tbl"), *DIMENSIONS), time, "db", "tbl")
