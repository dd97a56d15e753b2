"""Profiling-run history, asset selection and paging: latest-per-key windows, zero-filled pivots, semi and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a run.
STATUSES = ("STARTED", "RUNNING", "SUCCESS", "FAILED", "KILLED", "UNKNOWN")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def filter_rows(df: DataFrame, **wanted) -> DataFrame:
    """Optional filters: ``<column>_from``, ``<column>_to`` (inclusive) or ``<column>`` in a list; None filters nothing."""
    tests = []
    for name, value in wanted.items():
        if value is None:
            continue
        if name.endswith("_from"):
            tests.append(F.col(name[:-5]) >= value)
        elif name.endswith("_to"):
            tests.append(F.col(name[:-3]) <= value)
        else:
            tests.append(F.col(name).isin(list(value)))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def status_counts(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, one column of counts for each status, 0 where there are none)."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))


def dataset_asset_counts(members: DataFrame, runs: DataFrame, profiler: str, start: Column, end: Column) -> DataFrame:
    """Distinct assets of each dataset that the profiler ran on in (start, end]; 0 for datasets without any."""
    done = runs.where((F.col("profilerinstancename") == profiler) & (F.col("lastupdated") > start) & (F.col("lastupdated") <= end)).select("assetid").distinct().withColumn("hit", F.col("assetid"))
    return members.join(done, "assetid", "left").groupBy("datasetname").agg(F.count_distinct("hit").alias("assets"))


def assets_per_profiler(instances: DataFrame, jobs: DataFrame, runs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Distinct assets of each profiler instance over its jobs of a time range; 0 for instances without jobs."""
    own = instances.select(F.col("id").alias("instance_id"), "name")
    in_range = jobs.where((F.col("start") >= start) & (F.col("start") <= end)).select(F.col("id").alias("jobid"), F.col("profilerinstanceid").alias("instance_id"))
    return own.join(in_range, "instance_id", "left").join(runs.select("jobid", "assetid"), "jobid", "left").groupBy("instance_id", "name").agg(F.count_distinct("assetid").alias("assets"))


def jobs_per_status(instances: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of every instance by status, zero-filled."""
    counts = status_counts(jobs, "profilerinstanceid")
    own = instances.select(F.col("id").alias("profilerinstanceid"), "name")
    return own.join(counts, "profilerinstanceid", "left").fillna(0)


def last_run(runs: DataFrame) -> DataFrame:
    """The latest history row of each (asset, profiler); ties go to the higher id, null times last."""
    return latest(runs, ["assetid", "profilerinstancename"], F.desc_nulls_last("lastupdated"), F.desc("id"))


def last_run_per_profiler(instances: DataFrame, runs: DataFrame, asset: str) -> DataFrame:
    """Every instance and its latest run on one asset, if any."""
    newest = latest(runs.where(F.col("assetid") == asset), ["profilerinstancename"], F.desc_nulls_last("lastupdated"), F.desc("id"))
    return instances.select("name").distinct().join(newest.select(F.col("profilerinstancename").alias("name"), F.col("id").alias("run_id"), "status"), "name", "left")


def status_per_day(runs: DataFrame) -> DataFrame:
    """Per day the assets by the status of their last run of that day, zero-filled."""
    return status_counts(latest(runs.withColumn("day", F.to_date("lastupdated")), ["assetid", "day"], F.desc("lastupdated"), F.desc("id")), "day")


def latest_versions(instances: DataFrame) -> DataFrame:
    return latest(instances, ["name"], F.desc("version"))


def recently_run(runs: DataFrame, profiler: str, since: Column) -> DataFrame:
    """Assets whose latest run by the profiler is under way or done and newer than ``since``."""
    newest = latest(runs.where(F.col("profilerinstancename") == profiler), ["assetid"], F.desc_nulls_last("lastupdated"), F.desc("id"))
    return newest.where(F.col("status").isin("RUNNING", "STARTED", "SUCCESS") & (F.col("lastupdated") > since)).select("assetid")


def select_assets(assets: DataFrame, drop: list[Column], pick: list[Column]) -> DataFrame:
    """Assets that no drop filter and some pick filter holds for; without pick filters, none. A null test does not hold."""
    holds = lambda tests: reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), tests, F.lit(False))
    return assets.where(~holds(drop) & holds(pick))


def request_batches(requests: DataFrame, batch: int = 10, cap: int = 100) -> DataFrame:
    """Of the requests for an asset that of highest priority; the first ``cap`` by priority, in batches."""
    one = latest(requests, ["assetid"], F.desc("priority"), F.asc("id"))
    first = one.orderBy(F.desc("priority"), "id").limit(cap)
    rank = F.row_number().over(Window.orderBy(F.desc("priority"), "id"))
    return first.withColumn("place", rank).withColumn("batch", F.ceil(F.col("place") / batch).cast("int"))


def paginate(df: DataFrame, sortable: tuple[str, ...], by: str, descending: bool, offset: int, size: int, key: str = "id") -> DataFrame:
    """One page in the order of a column that may be sorted by, ties by ``key``."""
    if by not in sortable:
        raise ValueError(f"cannot sort by {by}; one of {', '.join(sortable)} is needed")
    return df.orderBy(F.desc(by) if descending else F.asc(by), key).offset(offset).limit(size)
