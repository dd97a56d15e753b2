"""Dated and partitioned parquet stores, audit files, metric views and the profile store."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.expr import period_days

AUDIT_SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "result" else T.StringType()) for n in ("resource", "resType", "access", "action", "result", "reqUser")])
_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


def days_of(end: dt.date, period: str) -> list[dt.date]:
    return [end - dt.timedelta(days=i) for i in range(period_days(period))][::-1]


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def existing(spark: SparkSession, paths: list[str], least_bytes: int = 0) -> list[str]:
    """Those of the files and folders that are there and hold more than so many bytes, by the Hadoop file system of each path."""
    out = []
    for p in paths:
        fs, path = _at(spark, p)
        if fs.exists(path) and fs.getContentSummary(path).getLength() > least_bytes:
            out.append(p)
    return out


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, of which there may be none."""
    fs, path = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, found = _at(spark, path)
    fs.delete(found, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to a name that nothing has; parents are made."""
    fs, path = _at(spark, target)
    fs.mkdirs(path.getParent())
    if fs.exists(path) or not fs.rename(_at(spark, source)[1], path):
        raise FileExistsError(f"cannot move {source} to {target}")


def read_audit(spark: SparkSession, base: str, end: dt.date, period: str) -> DataFrame:
    """Raw audit JSON of a period's day folders ``{base}/yyyyMMdd``; days without data are skipped, none at all is an error."""
    paths = existing(spark, [f"{base}/{d:%Y%m%d}" for d in days_of(end, period)], 10)
    if not paths:
        raise FileNotFoundError(f"no audit data under {base} for the {period} period to {end}")
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "PERMISSIVE").json(paths)


def read_days(spark: SparkSession, base: str, days: list[dt.date], schema: T.StructType | str | None = None) -> DataFrame:
    """``{base}/date=…`` of these days. Only their folders are listed and read, so days or a tree that are not there have no rows; the
    schema (without the date) is needed where nothing may be there, and saves a look into the files elsewhere."""
    paths = existing(spark, [f"{base}/date={d}" for d in days])
    fields = None if schema is None else [*T._parse_datatype_string(schema).fields] if isinstance(schema, str) else [*schema.fields]
    if fields is not None:
        whole = T.StructType([*(f for f in fields if f.name != "date"), T.StructField("date", T.DateType())])
        return spark.read.schema(whole).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], whole)
    if not paths:
        raise FileNotFoundError(f"none of the days is under {base}, and no schema is given")
    return spark.read.option("basePath", base).parquet(*paths)


def read_rollup(spark: SparkSession, base: str, metric: str, end: dt.date, period: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Earlier daily roll-ups of a period."""
    return read_days(spark, f"{base}/{metric}/daily", days_of(end, period), schema)


def write_dated(df: DataFrame, base: str, metric: str, period: str, date: dt.date | None = None) -> str:
    """Overwrites the date partitions of ``{base}/{metric}/{period}`` that ``df`` holds; others stay."""
    rows = df if date is None else df.withColumn("date", F.lit(date))
    path = f"{base}/{metric}/{period}"
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return path


def write_partitions(df: DataFrame, path: str, *by: str) -> str:
    """Overwrites those partitions that ``df`` holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return path


def write_daily_and_snapshot(df: DataFrame, base: str, metric: str, date: dt.date) -> tuple[str, str]:
    """The same rows under ``daily/date=…`` and as ``snapshot``; computed once."""
    df = df.persist()
    try:
        daily, snapshot = write_dated(df, base, metric, "daily", date), f"{base}/{metric}/snapshot"
        df.write.mode("overwrite").parquet(snapshot)
    finally:
        df.unpersist()
    return daily, snapshot


def compact(spark: SparkSession, source: str, target: str, files: int | None = None) -> bool:
    """All partitions of ``source`` in a few files at another path, by default as many as their bytes ask for (Spark's advisory
    partition size); nothing is written, and False returned, if there are no rows."""
    rows = spark.read.parquet(source)
    if rows.isEmpty():
        return False
    (rows.repartition(files) if files else rows.hint("rebalance")).write.mode("overwrite").parquet(target)
    return True


def open_view(spark: SparkSession, path: str, name: str, cache: bool = True) -> DataFrame:
    """A stored metric as a temp view, cached until it is refreshed."""
    spark.read.parquet(path).createOrReplaceTempView(name)
    if cache:
        spark.catalog.cacheTable(name)
    return spark.table(name)


def refresh_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The view again after a write."""
    spark.catalog.uncacheTable(name)
    spark.catalog.refreshByPath(path)
    return open_view(spark, path, name)


def close_view(spark: SparkSession, name: str) -> None:
    spark.catalog.uncacheTable(name)
    spark.catalog.dropTempView(name)


def upsert_profiles(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("db", "tbl", "column_name")) -> DataFrame:
    """``stored`` with ``new``: columns of known tables are updated and their unknown columns skipped; unknown tables come in whole."""
    table, values = list(keys[:-1]), [c for c in stored.columns if c not in keys]
    known = stored.select(*table).distinct().withColumn("_known", F.lit(True))
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values)).withColumn("_in_new", F.lit(True))
    both = stored.withColumn("_in_old", F.lit(True)).join(fresh, list(keys), "full").join(known, table, "left")
    kept = both.where("_in_old or _known is null")
    return kept.select(*keys, *(F.coalesce(f"_new_{c}", c).alias(c) for c in values))


def set_status(history: DataFrame, updates: DataFrame) -> DataFrame:
    """``history`` with the status of the updates (jobid, new_status)."""
    return history.join(updates, "jobid", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


# --- stores that are rewritten in place: {base}[/column=value…]/version=n, of which readers take the highest
_VERSION = "version="


def _leaves(spark: SparkSession, folder: str, depth: int) -> list[str]:
    """Partition folders so many levels down, relative to the folder."""
    if depth == 0:
        return [""]
    return [f"{n}/{below}".rstrip("/") for n in listed(spark, folder) if "=" in n and not n.startswith(_VERSION) for below in _leaves(spark, f"{folder}/{n}", depth - 1)]


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[len(_VERSION) :]) for n in listed(spark, folder) if n.startswith(_VERSION))


def _move_in(spark: SparkSession, base: str, ready: str, depth: int) -> None:
    for leaf in _leaves(spark, ready, depth):
        place = f"{base}/{leaf}".rstrip("/")
        old = _versions(spark, place)
        rename(spark, f"{ready}/{leaf}".rstrip("/"), f"{place}/{_VERSION}{(old or [0])[-1] + 1}")
        for n in old[:-1]:  # the last one stays until the next write, for those who still read it
            remove(spark, f"{place}/{_VERSION}{n}")
    remove(spark, ready)


def recover(spark: SparkSession, base: str) -> None:
    """Ends what a stopped writer began: what was written whole is moved in, what was not is removed."""
    for name in listed(spark, base):
        if name.startswith("_ready-"):
            _move_in(spark, base, f"{base}/{name}", int(name.split("-")[1]))
        elif name.startswith(("_staged-", "_dropped-")):
            remove(spark, f"{base}/{name}")


def replace(df: DataFrame, base: str, *by: str) -> None:
    """``df`` in place of the partitions that it holds (without ``by``: of the whole store); others keep their files.

    It is written beside and moved in by one rename a partition, so a reader finds the old version or the new one whole, and one that
    already reads the old can go on. A stop before the renames loses the new version, a stop between them is ended by the next writer. One writer at a time."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    recover(spark, base)
    staged, ready = f"{base}/_staged-{name}", f"{base}/_ready-{len(by)}-{name}"
    (df.write.partitionBy(*by) if by else df.write).parquet(staged)
    rename(spark, staged, ready)
    _move_in(spark, base, ready, len(by))


def drop_partition(spark: SparkSession, base: str, column: str, value: str) -> bool:
    """Takes a partition away by one rename; False if there is none."""
    recover(spark, base)
    for name in listed(spark, base):
        if unquote(name) == f"{column}={value}":
            gone = f"{base}/_dropped-{uuid.uuid4().hex}"
            rename(spark, f"{base}/{name}", gone)
            remove(spark, gone)
            return True
    return False


def read_store(spark: SparkSession, base: str, *by: str, schema: T.StructType | None = None) -> DataFrame:
    """The store as it stands: each partition's last version. ``schema`` (with the partition columns) is needed where it may be empty."""
    paths = [f"{place}/{_VERSION}{found[-1]}" for leaf in _leaves(spark, base, len(by)) if (found := _versions(spark, place := f"{base}/{leaf}".rstrip("/")))]
    if not paths:
        if schema is None:
            raise FileNotFoundError(f"no version under {base}, and no schema is given")
        return spark.createDataFrame([], schema)
    read = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType())]))
    return read.option("basePath", base).parquet(*paths).drop("version")


def rewrite(base: str, by: str, touching: DataFrame, change: Callable[[DataFrame], DataFrame], schema: T.StructType | None = None) -> list:
    """``change`` applied to those partitions of a store that ``touching`` has rows of; returns their values. Others are not even read."""
    spark = touching.sparkSession
    values = [r[0] for r in touching.select(by).distinct().collect()]  # as many as there are partitions
    if values:
        recover(spark, base)
        replace(change(read_store(spark, base, by, schema=schema).where(F.col(by).isin(values))), base, by)
    return values


def upsert_stored(new: DataFrame, base: str, keys: tuple[str, ...] = ("db", "tbl", "column_name"), schema: T.StructType | None = None) -> list:
    """``upsert_profiles`` in a store partitioned by the first key: only the partitions that ``new`` has tables of are rewritten."""
    return rewrite(base, keys[0], new, lambda stored: upsert_profiles(stored, new, keys), schema)


def set_stored_status(updates: DataFrame, base: str, by: str, part: Column) -> list:
    """``set_status`` in a history partitioned by ``by``, which ``part`` works out from a row of the updates; only those partitions are rewritten."""
    placed = updates.withColumn(by, part)
    return rewrite(base, by, placed, lambda stored: set_status(stored, updates))
