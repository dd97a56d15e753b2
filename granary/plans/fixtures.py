"""Audit, history and catalog relations derived from the supplied tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source table, statement)
FIXTURES = {
    "audit": ("events", """SELECT event_id, ts AS evttime,
  CASE WHEN event_id % 17 = 0 THEN NULL
       WHEN event_id % 10 < 6 THEN concat('db', CAST(user_id % 3 AS STRING), '/t', CAST(user_id % 7 AS STRING), '/c', CAST(event_id % 4 AS STRING))
       WHEN event_id % 10 < 9 THEN concat('db', CAST(user_id % 3 AS STRING), '/t', CAST(user_id % 7 AS STRING))
       ELSE concat('/data/p', CAST(user_id % 11 AS STRING)) END AS resource,
  CASE WHEN event_id % 10 < 6 THEN '@column' WHEN event_id % 10 < 9 THEN '@table' ELSE 'path' END AS restype,
  CASE event_type WHEN 'view' THEN 'select' WHEN 'click' THEN 'select' WHEN 'purchase' THEN 'update' WHEN 'signup' THEN 'create' ELSE NULL END AS access,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'drop' ELSE 'select' END AS action,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 2 AS BIGINT) END AS result,
  concat('u', CAST(user_id % 5 AS STRING)) AS requser FROM {events}"""),
    "run_history": ("events", """SELECT event_id AS id, concat('prof', CAST(event_id % 4 AS STRING)) AS profilerinstancename,
  concat('db', CAST(user_id % 3 AS STRING), '.t', CAST(user_id AS STRING)) AS assetid, CAST(floor(event_id / 5) AS BIGINT) AS jobid,
  CASE event_type WHEN 'view' THEN 'SUCCESS' WHEN 'click' THEN 'FAILED' WHEN 'purchase' THEN 'RUNNING' WHEN 'signup' THEN 'STARTED' ELSE 'KILLED' END AS status,
  ts AS lastupdated FROM {events}"""),
    "jobs": ("orders", """SELECT o_orderkey AS id, CAST(o_custkey % 6 AS BIGINT) AS profilerinstanceid, concat('prof', CAST(o_custkey % 6 AS STRING)) AS profilerinstancename,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
  o_orderpriority AS queue, concat('s', CAST(o_custkey % 3 AS STRING)) AS submitter, o_orderdate AS start, o_orderdate AS lastupdated FROM {orders}"""),
    "profiler_instances": ("nation", """SELECT CAST(n_nationkey % 8 AS BIGINT) AS id, concat('prof', CAST(n_nationkey % 8 AS STRING)) AS name, n_name AS displayname,
  CAST(n_nationkey % 3 AS BIGINT) AS profilerid, CAST(floor(n_nationkey / 8) + 1 AS BIGINT) AS version, n_nationkey % 2 = 0 AS active FROM {nation}"""),
    "dataset_asset": ("customer", """SELECT DISTINCT concat('ds', CAST(c_nationkey % 4 AS STRING)) AS datasetname,
  concat('db', CAST(c_custkey % 3 AS STRING), '.t', CAST(c_custkey AS STRING)) AS assetid, CAST(10000 AS BIGINT) AS priority FROM {customer} WHERE c_custkey % 2 = 0"""),
    "table_catalog": ("part", """SELECT concat('db', CAST(p_size % 5 AS STRING), '.', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS table_name, concat('db', CAST(p_size % 5 AS STRING)) AS db,
  CAST(p_partkey * 1009 % 100003 AS BIGINT) AS size, CAST(p_partkey * 31 % 5003 AS BIGINT) AS numrows, CAST(p_size AS BIGINT) AS numpartitions,
  p_brand AS inputformat, p_type AS outputformat, DATE '2020-01-01' + CAST(p_partkey % 900 AS INT) AS createtime FROM {part}"""),
    "sensitivity": ("part", """SELECT concat('db', CAST(p_size % 5 AS STRING)) AS database, concat('t', CAST(p_partkey % 50 AS STRING)) AS table_name, concat('c', CAST(p_partkey AS STRING)) AS column_name,
  p_type AS label, CAST(p_partkey % 101 AS DOUBLE) AS percentmatch, CASE p_partkey % 3 WHEN 0 THEN 'suggested' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status FROM {part}"""),
    "points": ("customer", """SELECT c_custkey AS id, CAST(c_custkey * 37 % 1801 AS DOUBLE) / 10.0 - 90.0 AS lat, CAST(c_custkey * 91 % 3601 AS DOUBLE) / 10.0 - 180.0 AS lon,
  c_nationkey AS city, c_mktsegment AS country FROM {customer}"""),
    "pii_cells": ("documents", """SELECT doc_id, lang, source, regexp_extract(text, '([A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.]+)', 1) AS email_cell,
  regexp_extract(text, '([0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}})', 1) AS ip_cell FROM {documents}"""),
    # column names and comments as an information schema would list them, one for each part
    "column_list": ("part", """SELECT p_partkey AS id, concat(CASE p_partkey % 9 WHEN 0 THEN 'email_addr' WHEN 1 THEN 'ssn_no' WHEN 2 THEN 'c_name' WHEN 3 THEN 'city_name' WHEN 4 THEN 'lat' WHEN 5 THEN 'flat_zipcode'
  WHEN 6 THEN 'x1' WHEN 7 THEN 'amount' ELSE replace(p_name, ' ', '_') END, '_', CAST(p_size AS STRING)) AS column_name,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'the street of the customer' WHEN 2 THEN '' ELSE p_type END AS comment FROM {part}"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, statement = FIXTURES[name]
    return spark.sql(statement, **{source: table(spark, sf_dir, source)})


def with_fixtures(statement: str, *names: str) -> str:
    """``statement`` for DuckDB, with these fixtures as common table expressions before its own."""
    parts = [f"{n} AS ({FIXTURES[n][1].format(**{FIXTURES[n][0]: FIXTURES[n][0]})})" for n in names]
    if not parts:
        return statement
    body = statement.strip()
    return f"WITH {', '.join(parts)}" + (f", {body[5:]}" if body[:5].upper() == "WITH " else f" {body}")
