"""Audit-log analytics: roll-ups by table, user and path, top-k, activity classes, and dispatch of typed queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.expr import audit_table
from granary.operators.ranks import numbered

DIMENSIONS = ("access", "action", "result")


def with_table_name(audit: DataFrame) -> DataFrame:
    """Adds ``htable``: the ``db.table`` a row is about, null for paths."""
    return audit.withColumn("htable", audit_table(F.col("resource"), F.col("restype")))


def dimension_rows(audit: DataFrame, *keys: str) -> DataFrame:
    """(keys, dim, value): a row for each dimension; null values of a dimension are skipped."""
    each = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in DIMENSIONS))
    return audit.select(*keys, F.explode(each).alias("r")).select(*keys, "r.dim", "r.value").where("value is not null")


def breakdown(audit: DataFrame, *keys: str) -> DataFrame:
    """(keys, dim, value, count): rows by key and by each dimension; null values of a dimension are skipped."""
    return dimension_rows(audit, *keys).groupBy(*keys, "dim", "value").agg(F.count(F.lit(1)).alias("count"))


def hive_rollup(audit: DataFrame, by_user: bool = False) -> DataFrame:
    """Breakdown by (db, table), or also by user; a null user is the user ''."""
    named = with_table_name(audit).where("htable is not null")
    rows = named.select(F.split("htable", r"\.")[0].alias("db"), F.split("htable", r"\.")[1].alias("tbl"), F.coalesce("requser", F.lit("")).alias("requser"), *DIMENSIONS)
    return breakdown(rows, "db", "tbl", *(["requser"] if by_user else []))


def path_rollup(audit: DataFrame, by_user: bool = False) -> DataFrame:
    """Breakdown by resource, or also by user; rows without a resource are left out."""
    rows = audit.where("resource is not null").withColumn("requser", F.coalesce("requser", F.lit("")))
    return breakdown(rows, "resource", *(["requser"] if by_user else []))


def nested(rollup: DataFrame, *keys: str) -> DataFrame:
    """(keys, data): ``data`` is a struct of one map of counts a dimension."""
    maps = rollup.groupBy(*keys).agg(*(F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("dim") == d, F.struct("value", "count"))), lambda x: x.isNotNull()))).alias(d) for d in DIMENSIONS))
    return maps.select(*keys, F.struct(*DIMENSIONS).alias("data"))


def action_counts(audit: DataFrame) -> DataFrame:
    """(htable, count, selects, creates, drops) of every table."""
    return with_table_name(audit).where("htable is not null").groupBy("htable").agg(F.count(F.lit(1)).alias("count"), *(F.count_if(F.col("action") == a).alias(f"{a}s") for a in ("select", "create", "drop")))


def top_k(df: DataFrame, field: str, n: int, condition: str | None = None) -> DataFrame:
    """The ``n`` most frequent values of a field among rows that fulfil a condition given as SQL text."""
    rows = df.where(condition) if condition else df
    return rows.groupBy(field).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first(field)).limit(n)


def activity_tiles(audit: DataFrame, tiles: int = 10) -> DataFrame:
    """(htable, count, tile): tables in ``tiles`` classes of activity of even size, the first of which take what is over.

    Places come from ranges of the order and their counts, not from a window over all tables."""
    ranked = numbered(action_counts(audit).select("htable", "count"), F.asc("count"), F.asc("htable"))
    place, size, over = F.col("place"), F.floor(F.col("total") / tiles), F.col("total") % tiles
    large = over * (size + 1)  # places in tiles of one more
    tile = F.when(place <= large, F.ceil(place / (size + 1))).otherwise(over + F.ceil((place - large) / F.greatest(size, F.lit(1))))
    return ranked.select("htable", "count", tile.cast("int").alias("tile"))


def sql_job(df: DataFrame, view: str, statement: str) -> DataFrame:
    """User SQL over a frame under the name ``view``."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(statement)


#: query type -> function of the source frame and the query's parameters
HANDLERS: dict[str, Callable[..., DataFrame]] = {
    "TopKUsers": lambda df, **kw: top_k(df, kw.get("field", "requser"), int(kw.get("k", 10)), kw.get("filter")),
    "Sql": lambda df, **kw: sql_job(df, kw["view"], kw["sql"]),
    "HiveRangerAggregate": lambda df, **kw: hive_rollup(df),
    "HdfsRangerAggregate": lambda df, **kw: path_rollup(df),
}


def dispatch(df: DataFrame, jobs: list[dict]) -> dict[str, DataFrame]:
    """Results by name of the typed queries of a job, over one source."""
    out = {}
    for job in jobs:
        if job["type"] not in HANDLERS:
            raise ValueError(f"unknown query type {job['type']}")
        out[job["name"]] = HANDLERS[job["type"]](df, **job.get("params", {}))
    return out
