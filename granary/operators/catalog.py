"""Catalog statistics and the stored results of the sensitivity job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.expr import created_date, table_size_and_rows

def described(spark: SparkSession, db: str) -> DataFrame:
    """(table, db, information): the catalog's text about every table of a database, by one statement. Where that fails because of some table, table
    by table, and those that cannot be described are left out."""
    schema = "table string, db string, information string"
    try:
        found = spark.sql(f"SHOW TABLE EXTENDED IN `{db}` LIKE '*'").where("not isTemporary")
        return found.select(F.col("tableName").alias("table"), F.lit(db).alias("db"), "information")
    except Exception as e:
        _warn(spark, f"{db}: {e}")
    rows = []
    for t in spark.sql(f"SHOW TABLES IN `{db}`").where("not isTemporary").select("tableName").collect():
        try:
            rows += spark.sql(f"SHOW TABLE EXTENDED IN `{db}` LIKE '{t.tableName}'").select("tableName", F.lit(db), "information").collect()
        except Exception as e:  # a table that goes or fails meanwhile must not stop the crawl
            _warn(spark, f"{db}.{t.tableName}: {e}")
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _warn(spark: SparkSession, text: str) -> None:
    spark.sparkContext._jvm.org.slf4j.LoggerFactory.getLogger("granary").warn(text)


def inventory(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """One row for each catalogued table; tables that cannot be described are left out. The catalog is asked once a database, and once more for the
    partitions of each partitioned table; its answers are read by expressions."""
    parts = [described(spark, db) for db in databases or [d.name for d in spark.catalog.listDatabases()]]
    found = reduce(DataFrame.unionByName, parts)
    line = lambda name: F.nullif(F.trim(F.regexp_extract("information", rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    raw = found.select("table", "db", line("Created Time").alias("createTime"), line("Table Properties").alias("parameters"), line("Statistics").alias("statistics"), line("Partition Columns").alias("by"), F.coalesce(line("InputFormat"), line("Provider")).alias("inputFormat"), F.coalesce(line("OutputFormat"), line("Provider")).alias("outputFormat"))
    counts = []
    for r in raw.where("by is not null and by <> '[]'").select("db", "table").collect():
        try:
            counts.append((r.db, r.table, spark.sql(f"SHOW PARTITIONS `{r.db}`.`{r.table}`").count()))
        except Exception as e:
            _warn(spark, f"{r.db}.{r.table}: {e}")
    numbers = spark.createDataFrame(counts, "db string, table string, numPartitions bigint")
    size, n = table_size_and_rows(F.col("parameters"), F.col("statistics"))
    rows = raw.join(F.broadcast(numbers), ["db", "table"], "left").withColumn("numPartitions", F.coalesce("numPartitions", F.lit(0).cast("bigint")))  # a row a table
    return rows.select("table", "db", created_date(F.col("createTime")).alias("createTime"), size.alias("size"), n.alias("numRows"), "numPartitions", "inputFormat", "outputFormat")


def top_tables(catalog: DataFrame, by: str, n: int = 10) -> DataFrame:
    return catalog.orderBy(F.desc(by), "table_name").limit(n).select("table_name", by)


def group_counts(df: DataFrame, *keys: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent groups."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *keys).limit(n)


def profiled_tables(catalog: DataFrame, profiled: DataFrame) -> DataFrame:
    """How many catalogued tables have results: (n)."""
    return catalog.join(profiled.select("table_name").distinct(), "table_name", "left_semi").agg(F.count(F.lit(1)).alias("n"))
