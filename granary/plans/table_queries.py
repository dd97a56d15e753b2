"""Queries of scans, scalar functions, joins, aggregates, windows, sorts and sets over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import expr
from granary.operators import audit as au
from granary.operators import catalog as ca
from granary.operators import geo
from granary.operators import history as hi
from granary.operators import mergeable as mg
from granary.operators import sensitive as se
from granary.operators import stats as st

from granary.sources.scratch import written

from .registry import query

_NTZ = "timestamp_ntz"


def _ts(text: str):
    return F.lit(text).cast(_NTZ)


# --- scans
query("scan_table", "orders", oracle="SELECT * FROM orders")(lambda t: t)
query("sample_percent", "orders", oracle="SELECT * FROM orders WHERE o_orderkey % 100 < 10")(lambda t: t.where(F.pmod("o_orderkey", F.lit(100)) < 10))
query("sample_percent_random", "lineitem")(lambda t: t.sample(False, 0.1, 7))
query("sample_rows_random", "documents")(lambda t: t.select("doc_id", "lang", "source").orderBy(F.rand(11), "doc_id").limit(100))
query("sample_head", "customer", oracle="SELECT * FROM customer ORDER BY c_custkey LIMIT 100")(lambda t: t.orderBy("c_custkey").limit(100))


@query("period_dates", "audit", oracle="""
WITH e AS (SELECT max(CAST(evttime AS DATE)) AS d FROM audit), p(period, n) AS (VALUES ('daily', 1), ('weekly', 7), ('monthly', 30), ('snapshot', 1)),
x AS (SELECT period, CAST(unnest(generate_series(d - CAST(n - 1 AS INT), d, INTERVAL 1 DAY)) AS DATE) AS day FROM e, p)
SELECT x.period, x.day, count(a.event_id) AS events FROM x LEFT JOIN audit a ON CAST(a.evttime AS DATE) = x.day GROUP BY x.period, x.day""")
def _period_dates(audit: DataFrame) -> DataFrame:
    """The days of every period that ends with the last audited day, and their events."""
    end = audit.agg(F.max(F.to_date("evttime")).alias("d"))
    days = end.select(F.explode(F.array(*(F.struct(F.lit(p).alias("period"), expr.period_dates(F.col("d"), p).alias("days")) for p in ("daily", "weekly", "monthly", "snapshot")))).alias("r"))
    days = days.select("r.period", F.explode("r.days").alias("day"))
    n = audit.groupBy(F.to_date("evttime").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return days.join(n, "day", "left").select("period", "day", F.coalesce("events", F.lit(0)).alias("events"))


@query("audit_end_date", "events", oracle="""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts WHEN event_id % 3 = 1 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE TIMESTAMP '2024-05-31 00:00:00' END AS end_at FROM events""")
def _audit_end(events: DataFrame) -> DataFrame:
    """Jobs with an end of their own, of the same day, and of the day before, with a fixed clock."""
    millis = F.when(F.col("event_id") % 3 == 0, F.unix_millis(F.col("ts").cast("timestamp")))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    exact = expr.audit_end(millis, F.col("event_id") % 3 == 1, now)
    micros = F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp"))  # the source keeps microseconds, jobs milliseconds
    return events.select("event_id", F.coalesce(F.when(F.date_trunc("millisecond", micros) == exact, micros), exact).cast(_NTZ).alias("end_at"))


query("asset_listing", "table_catalog", oracle="SELECT concat(db, '.', split_part(table_name, '.', 2)) AS asset_id, concat(db, '##', split_part(table_name, '.', 2)) AS bulk_id FROM table_catalog")(
    lambda t: t.select(F.concat_ws(".", "db", F.substring_index("table_name", ".", -1)).alias("asset_id"), F.concat_ws("##", "db", F.substring_index("table_name", ".", -1)).alias("bulk_id"))
)


@query("columns_by_type", "lineitem", oracle="""SELECT 'numeric' AS kind, unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax']) AS column_name, (SELECT count(*) FROM lineitem) AS n
UNION ALL SELECT 'string', unnest(['l_returnflag','l_linestatus']), (SELECT count(*) FROM lineitem) UNION ALL SELECT 'undefined', 'l_shipdate', (SELECT count(*) FROM lineitem)""")
def _columns_by_type(t: DataFrame) -> DataFrame:
    """Columns of each class, with the values they hold."""
    kinds = {c: k for k in ("numeric", "string", "boolean", "undefined") for c in st.columns_of(t, k)}
    rows = st.aggregate_columns(t, list(kinds), ["non_null_count"])
    of = F.create_map(*(x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))))
    return rows.select(F.element_at(of, F.col("column_name")).alias("kind"), "column_name", F.col("non_null_count").alias("n"))


# --- scalar functions
query("string_lengths", "documents", oracle="SELECT doc_id, coalesce(length(text), 0) AS text_length, coalesce(length(lang), 0) AS lang_length FROM documents")(
    lambda t: t.select("doc_id", expr.string_length(F.col("text")).alias("text_length"), expr.string_length(F.col("lang")).alias("lang_length"))
)
_HTABLE = "CASE WHEN restype IN ('@column', '@table') AND strpos(resource, '/') > 0 THEN split_part(resource, '/', 1) || '.' || split_part(resource, '/', 2) END"
query("audit_table_name", "audit", oracle=f"SELECT event_id, {_HTABLE} AS htable FROM audit")(lambda t: au.with_table_name(t).select("event_id", "htable"))
query("filter_expression", "audit", oracle="SELECT event_id, requser, action FROM audit WHERE action = 'create' AND requser <> 'u1'")(lambda t: t.where("action = 'create' and requser <> 'u1'").select("event_id", "requser", "action"))


@query("parse_table_stats", "table_catalog", oracle="SELECT table_name, size AS total_size, numrows AS num_rows FROM table_catalog")
def _parse_stats(t: DataFrame) -> DataFrame:
    """Sizes and rows read back from both texts in which a catalog gives them."""
    parameters = F.when(F.col("numpartitions") % 2 == 0, F.format_string("[totalSize=%d, numRows=%d]", "size", "numrows")).otherwise(F.lit("[transient=1]"))
    size, rows = expr.table_size_and_rows(parameters, F.format_string("%d bytes, %d rows", "size", "numrows"))
    return t.select("table_name", size.alias("total_size"), rows.alias("num_rows"))


@query("parse_created_date", "orders", oracle="SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN DATE '1970-01-01' ELSE CAST(o_orderdate AS DATE) END AS created FROM orders")
def _created(t: DataFrame) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 == 0, "UNKNOWN").otherwise(F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss 'UTC' yyyy"))
    return t.select("o_orderkey", expr.created_date(text).alias("created"))


query("qualified_name_build", "table_catalog", oracle="SELECT table_name, table_name || '.c1@cl' AS qualified FROM table_catalog")(lambda t: t.select("table_name", expr.qualified("cl", F.col("table_name"), F.lit("c1")).alias("qualified")))


@query("qualified_name_split", "table_catalog", oracle="SELECT db, split_part(table_name, '.', 2) AS tbl, CASE WHEN numpartitions % 2 = 0 THEN 'c1' END AS col FROM table_catalog")
def _split_name(t: DataFrame) -> DataFrame:
    name = F.concat("table_name", F.when(F.col("numpartitions") % 2 == 0, ".c1").otherwise(""), F.lit("@cl"))
    return t.select(*(c.alias(n) for c, n in zip(expr.split_qualified(name), ("db", "tbl", "col"), strict=True)))


query("tag_prefix", "sensitivity", oracle="SELECT column_name, 'dp_' || label AS tag, label FROM sensitivity WHERE status IS NOT NULL")(
    lambda t: t.withColumn("tag", F.concat(F.lit("dp_"), "label")).where(F.col("tag").startswith("dp_") & F.col("status").isNotNull()).select("column_name", "tag", F.regexp_replace("tag", "^dp_", "").alias("label"))
)
_EMAIL, _IP = se.PATTERNS["email"][0], se.PATTERNS["ipaddress"][0]
query("regex_full_match", "pii_cells", oracle=f"SELECT doc_id, regexp_full_match(email_cell, '{_EMAIL}') AS is_email, regexp_full_match(ip_cell, '{_IP}') AS is_ip FROM pii_cells")(
    lambda t: t.select("doc_id", expr.whole_match(F.col("email_cell"), se.PATTERNS["email"]).alias("is_email"), expr.whole_match(F.col("ip_cell"), se.PATTERNS["ipaddress"]).alias("is_ip"))
)
query("contains_keyword", "part", oracle="SELECT p_partkey, contains(p_name, 'an') OR contains('an', p_name) AS hit, contains(p_type, p_brand) AS brand_in_type FROM part")(
    lambda t: t.select("p_partkey", (F.contains("p_name", F.lit("an")) | F.contains(F.lit("an"), F.col("p_name"))).alias("hit"), F.contains("p_type", F.col("p_brand")).alias("brand_in_type"))
)
query("haversine_km", "points", oracle="SELECT id, round(12742 * asin(sqrt(least(1.0, greatest(0.0, 0.5 - cos(radians(lat - 48.8)) / 2 + cos(radians(48.8)) * cos(radians(lat)) * (1 - cos(radians(lon - 2.3))) / 2)))), 4) AS km FROM points")(
    lambda t: t.select("id", F.round(expr.haversine_km(F.lit(48.8), F.lit(2.3), F.col("lat"), F.col("lon")), 4).alias("km"))
)
query("euclid_distance", "points", oracle="SELECT id, round(sqrt((lat - 48.8) * (lat - 48.8) + (lon - 2.3) * (lon - 2.3)), 6) AS dist FROM points")(lambda t: t.select("id", F.round(expr.euclid(F.col("lat"), F.col("lon"), F.lit(48.8), F.lit(2.3)), 6).alias("dist")))
query("filter_jobs", "jobs", oracle="SELECT id, status, submitter FROM jobs WHERE start >= TIMESTAMP '1995-01-01' AND start <= TIMESTAMP '1996-12-31' AND status IN ('SUCCESS', 'FAILED')")(
    lambda t: hi.filter_rows(t, start_from=_ts("1995-01-01"), start_to=_ts("1996-12-31"), status=["SUCCESS", "FAILED"], profilerinstanceid=None).select("id", "status", "submitter")
)
query("job_details", "events", oracle="""SELECT event_id, json_extract_string('{"appInfo":{"sparkUiUrl":"http://ui/' || event_id || '","driverLogUrl":"http://log/' || user_id || '"}}', '$.appInfo.sparkUiUrl') AS ui, 'http://log/' || user_id AS log FROM events""")(
    lambda t: t.withColumn("details", F.format_string('{"appInfo":{"sparkUiUrl":"http://ui/%d","driverLogUrl":"http://log/%d"}}', "event_id", "user_id")).select("event_id", F.get_json_object("details", "$.appInfo.sparkUiUrl").alias("ui"), F.get_json_object("details", "$.appInfo.driverLogUrl").alias("log"))
)
query("filter_history_running", "run_history", oracle="SELECT id, assetid, status FROM run_history WHERE status IN ('STARTED', 'RUNNING') AND profilerinstancename = 'prof1'")(lambda t: hi.filter_rows(t, status=["STARTED", "RUNNING"], profilerinstancename=["prof1"]).select("id", "assetid", "status"))


@query("flatten_tags", "sensitivity", oracle="""SELECT database, table_name, column_name, CASE k WHEN 0 THEN label ELSE label || '_new' END AS label, CASE k WHEN 0 THEN percentmatch ELSE 100.0 END AS percentmatch, CAST(k AS INT) AS place
FROM sensitivity, generate_series(0, 1) g(k) WHERE k = 0 OR status = 'accepted'""")
def _flatten(t: DataFrame) -> DataFrame:
    """Requests of changed and new tags, flattened; new tags count 100 %."""
    put = F.array(F.struct("label", F.col("percentmatch").alias("p")))
    post = F.when(F.col("status") == "accepted", F.array(F.struct(F.concat("label", F.lit("_new")).alias("label"), F.lit(None).cast("double").alias("p"))))
    rows = t.select("database", "table_name", "column_name", F.posexplode(F.concat(put, F.coalesce(post, F.array().cast("array<struct<label:string,p:double>>")))).alias("place", "x"))
    return rows.select("database", "table_name", "column_name", "x.label", F.coalesce("x.p", F.lit(100.0)).alias("percentmatch"), "place")


@query("nested_field_select", "audit", oracle=f"SELECT split_part(h, '.', 1) AS db, split_part(h, '.', 2) AS tbl, action AS value, count(*) AS count FROM (SELECT {_HTABLE} AS h, action FROM audit) WHERE h IS NOT NULL AND action IS NOT NULL GROUP BY 1, 2, 3")
def _nested(t: DataFrame) -> DataFrame:
    return au.nested(au.hive_rollup(t), "db", "tbl").select("db", "tbl", F.explode("data.action").alias("value", "count"))


@query("type_names", "orders", oracle="SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name, unnest(['long','long','string','double','timestamp_ntz','string']) AS type_name, unnest([(SELECT count(*) FROM orders)] || [(SELECT count(*) FROM orders)] || [(SELECT count(*) FROM orders)] || [(SELECT count(*) FROM orders)] || [(SELECT count(*) FROM orders)] || [(SELECT count(*) FROM orders)]) AS n")
def _types(t: DataFrame) -> DataFrame:
    """Display types, with the values of each column."""
    t = t.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    names = F.create_map(*(x for f in t.schema for x in (F.lit(f.name), F.lit(expr.display_type(f.dataType)))))
    rows = st.aggregate_columns(t, t.columns, ["non_null_count"])
    return rows.select("column_name", F.element_at(names, F.col("column_name")).alias("type_name"), F.col("non_null_count").alias("n"))


query("date_render", "events", oracle="SELECT event_id, strftime(ts, '%Y%m%d') AS day_key, strftime(ts, '%Y-%m-%d') AS day_text, CAST(ts AS DATE) AS day FROM events")(
    lambda t: t.select("event_id", F.date_format("ts", "yyyyMMdd").alias("day_key"), F.date_format("ts", "yyyy-MM-dd").alias("day_text"), F.to_date("ts").alias("day"))
)


@query("metric_json_text", "orders", oracle="""SELECT 'o_orderpriority' AS column_name, '[' || string_agg('{"item":' || to_json(i) || ',"count":' || n || '}', ',' ORDER BY i) || ']' AS items FROM (SELECT o_orderpriority AS i, count(*) AS n FROM orders GROUP BY 1)""")
def _json(t: DataFrame) -> DataFrame:
    counts = t.groupBy(F.col("o_orderpriority").alias("item")).agg(F.count(F.lit(1)).alias("count")).withColumn("column_name", F.lit("o_orderpriority"))
    return st.json_text(counts, "column_name", ["item", "count"], "items")


# --- joins
query("profiled_table_count", "table_catalog", "sensitivity", oracle="SELECT count(*) AS n FROM table_catalog WHERE db || '.' || CAST(numpartitions AS STRING) IN (SELECT database || '.' || substr(table_name, 2) FROM sensitivity)")(
    lambda c, s: ca.profiled_tables(c.select(F.concat_ws(".", "db", F.col("numpartitions").cast("string")).alias("table_name")), s.select(F.concat_ws(".", "database", F.substring("table_name", 2, 9)).alias("table_name")))
)
query("dataset_asset_count", "dataset_asset", "run_history", oracle="""SELECT d.datasetname, count(DISTINCT r.assetid) AS assets FROM dataset_asset d LEFT JOIN run_history r ON r.assetid = d.assetid AND r.profilerinstancename = 'prof1'
AND r.lastupdated > TIMESTAMP '2024-01-01' AND r.lastupdated <= TIMESTAMP '2024-01-20' GROUP BY d.datasetname""")(lambda d, r: hi.dataset_asset_counts(d, r, "prof1", _ts("2024-01-01"), _ts("2024-01-20")))
_LATEST_I = "i AS (SELECT id, name, displayname, profilerid, version, active FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS k FROM profiler_instances) WHERE k = 1)"
query("assets_per_profiler", "profiler_instances", "jobs", "run_history", oracle=f"""WITH {_LATEST_I} SELECT i.id AS instance_id, i.name, count(DISTINCT r.assetid) AS assets FROM i LEFT JOIN jobs j ON j.profilerinstanceid = i.id AND j.start >= TIMESTAMP '1993-01-01'
AND j.start <= TIMESTAMP '1996-01-01' LEFT JOIN run_history r ON r.jobid = j.id GROUP BY i.id, i.name""")(lambda i, j, r: hi.assets_per_profiler(hi.latest_versions(i), j, r, _ts("1993-01-01"), _ts("1996-01-01")))
_COUNTS = ", ".join(f"count(CASE WHEN {{0}}status = '{s}' THEN 1 END) AS {s.lower()}" for s in hi.STATUSES)
query("jobs_per_status", "profiler_instances", "jobs", oracle=f"WITH {_LATEST_I} SELECT i.id AS profilerinstanceid, i.name, {_COUNTS.replace('{0}', 'j.')} FROM i LEFT JOIN jobs j ON j.profilerinstanceid = i.id GROUP BY i.id, i.name")(lambda i, j: hi.jobs_per_status(hi.latest_versions(i), j))
query("last_run_per_profiler", "profiler_instances", "run_history", oracle="""SELECT p.name, r.id AS run_id, r.status FROM (SELECT DISTINCT name FROM profiler_instances) p LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY profilerinstancename ORDER BY lastupdated DESC, id DESC) AS k FROM run_history WHERE assetid = 'db1.t7') r ON r.profilerinstancename = p.name AND r.k = 1""")(lambda i, r: hi.last_run_per_profiler(i, r, "db1.t7"))
query("latest_status_per_day", "run_history", oracle=f"SELECT day, {_COUNTS.replace('{0}', '')} FROM (SELECT *, CAST(lastupdated AS DATE) AS day, row_number() OVER (PARTITION BY assetid, CAST(lastupdated AS DATE) ORDER BY lastupdated DESC, id DESC) AS k FROM run_history) WHERE k = 1 GROUP BY day")(hi.status_per_day)
query("instances_with_definition", "profiler_instances", "region", oracle="SELECT p.id, p.name, p.version, r.r_name FROM profiler_instances p JOIN region r ON r.r_regionkey = p.profilerid WHERE p.active")(
    lambda i, r: i.where("active").join(r, F.col("profilerid") == F.col("r_regionkey")).select("id", "name", "version", "r_name")
)
query("pick_in_collection", "run_history", "dataset_asset", oracle="SELECT DISTINCT assetid FROM run_history WHERE assetid IN (SELECT assetid FROM dataset_asset)")(lambda r, d: r.select("assetid").distinct().join(d.select("assetid"), "assetid", "left_semi"))
_RECENT = "(SELECT assetid FROM (SELECT *, row_number() OVER (PARTITION BY assetid ORDER BY lastupdated DESC, id DESC) AS k FROM run_history WHERE profilerinstancename = 'prof2') WHERE k = 1 AND status IN ('RUNNING', 'STARTED', 'SUCCESS') AND lastupdated > TIMESTAMP '2024-01-15')"
query("drop_recently_run", "run_history", oracle=f"SELECT DISTINCT assetid FROM run_history WHERE assetid NOT IN {_RECENT}")(lambda r: r.select("assetid").distinct().join(hi.recently_run(r, "prof2", _ts("2024-01-15")), "assetid", "left_anti"))


@query("asset_selection", "run_history", "dataset_asset", oracle=f"SELECT DISTINCT assetid FROM run_history WHERE NOT (assetid IN {_RECENT} OR assetid LIKE 'db0%') AND (assetid IN (SELECT assetid FROM dataset_asset) OR assetid LIKE '%7')")
def _selection(r: DataFrame, d: DataFrame) -> DataFrame:
    flags = lambda df, name: df.select("assetid").distinct().withColumn(name, F.lit(True))
    assets = r.select("assetid").distinct().join(flags(hi.recently_run(r, "prof2", _ts("2024-01-15")), "recent"), "assetid", "left").join(flags(d, "member"), "assetid", "left")
    return hi.select_assets(assets, [F.col("recent"), F.col("assetid").startswith("db0")], [F.col("member"), F.col("assetid").endswith("7")]).select("assetid")


_KW = ", ".join(f"('{k}', '{t}')" for k, ts in se.KEYWORDS.items() for t in ts)
query("column_keyword_match", "column_list", oracle=f"WITH k(label, token) AS (VALUES {_KW}) SELECT DISTINCT column_name, label FROM column_list JOIN k ON contains(column_name, token)")(lambda t: se.keyword_matches(t.select("column_name").distinct(), se.keyword_table(t.sparkSession)))
_GEO = ", ".join(f"('{w}', {i})" for i, w in enumerate(geo.LOCATION_WORDS))
query("location_keyword_match", "column_list", oracle=f"""WITH k(word, pos) AS (VALUES {_GEO}), w AS (SELECT id, column_name AS x FROM column_list UNION ALL SELECT id, unnest(string_split(comment, ' ')) FROM column_list WHERE comment IS NOT NULL)
SELECT c.id, c.column_name, (SELECT k.word FROM w JOIN k ON contains(w.x, k.word) OR contains(k.word, w.x) WHERE w.id = c.id AND length(w.x) > 1 ORDER BY k.pos DESC LIMIT 1) AS keyword FROM column_list c""")(lambda t: geo.location_keyword(t).select("id", "column_name", "keyword"))
query("points_near_centers", "points", oracle="""SELECT c.id, count(p.id) AS near FROM (SELECT * FROM points WHERE id % 20 = 0) c LEFT JOIN points p ON 12742 * asin(sqrt(least(1.0, greatest(0.0, 0.5 - cos(radians(p.lat - c.lat)) / 2 + cos(radians(c.lat)) * cos(radians(p.lat)) * (1 - cos(radians(p.lon - c.lon))) / 2)))) < 100 GROUP BY c.id""")(
    lambda t: geo.points_near(t.where(F.col("id") % 20 == 0), t)
)


@query("merge_tags", "sensitivity", oracle="""WITH n AS (SELECT column_name, label, percentmatch FROM sensitivity WHERE status = 'suggested'), o AS (SELECT column_name, label FROM sensitivity WHERE status = 'accepted' OR length(column_name) = 3),
f AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.column_name = n.column_name AND o.label = n.label)) SELECT column_name, label, percentmatch FROM f UNION ALL SELECT column_name, label, 100.0 FROM o""")
def _merge_tags(t: DataFrame) -> DataFrame:
    known = t.where("status = 'accepted' or length(column_name) = 3").select("column_name", "label")
    columns = t.select("column_name").distinct().withColumn("column_id", F.xxhash64("column_name"))
    return se.merge_tags(t.where("status = 'suggested'").select("column_name", "label", "percentmatch"), known, columns)[1]


@query("frequent_item_exact_counts", "orders", oracle="SELECT 'o_orderpriority' AS column_name, o_orderpriority AS item, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2")
def _exact(t: DataFrame) -> DataFrame:
    columns = ["o_orderpriority", "o_orderstatus"]
    return st.exact_counts(t, columns)


# --- aggregates
query("row_count", "lineitem", oracle="SELECT count(*) AS row_count FROM lineitem")(lambda t: t.agg(F.count(F.lit(1)).alias("row_count")))
query("null_counts", "documents", "labels", oracle="SELECT unnest(['doc_id', 'text', 'quality', 'toxic']) AS column_name, unnest([count(*) - count(d.doc_id), count(*) - count(text), count(*) - count(quality), count(*) - count(toxic)]) AS null_count FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(
    lambda d, l: st.aggregate_columns(d.join(l, "doc_id", "left"), ["doc_id", "text", "quality", "toxic"], ["null_count"])  # noqa: E741
)
query("boolean_counts", "profiler_instances", oracle="SELECT 'active' AS column_name, count(CASE WHEN active THEN 1 END) AS true_count, count(CASE WHEN NOT active THEN 1 END) AS false_count, count(*) - count(active) AS null_count FROM profiler_instances")(
    lambda t: st.aggregate_columns(t, ["active"], ["true_count", "false_count", "null_count"])
)
_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


_DESC = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in _NUM)
query("describe_numeric", "lineitem", oracle=_DESC)(lambda t: _rounded(st.aggregate_columns(t, _NUM, ["non_null_count", "mean", "stddev", "min", "max"]), "mean", "stddev"))
query("describe_string_length", "documents", oracle=" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, round(avg(coalesce(length({c}), 0)), 4) AS mean_length, round(stddev_samp(coalesce(length({c}), 0)), 4) AS stddev_length, min(coalesce(length({c}), 0)) AS min_length, max(coalesce(length({c}), 0)) AS max_length FROM documents" for c in ("text", "lang", "source")))(
    lambda t: _rounded(st.aggregate_columns(t, ["text", "lang", "source"], ["non_null_count", "mean_length", "stddev_length", "min_length", "max_length"]), "mean_length", "stddev_length")
)


@query("approx_distinct", "orders", oracle=" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, TRUE AS within_bound FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def _approx(t: DataFrame) -> DataFrame:
    rows = st.aggregate_columns(t, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["approx_distinct", "exact_distinct"])
    return rows.select("column_name", F.col("exact_distinct").alias("exact"), (F.abs(F.col("approx_distinct") - F.col("exact_distinct")) <= 3 * st.DISTINCT_ERROR * F.col("exact_distinct")).alias("within_bound"))


query("quantiles", "orders", oracle=" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS quartile, CAST(quantile_disc({c}, {p}) AS DOUBLE) AS value FROM orders" for c in ("o_totalprice", "o_custkey") for p in st.PROBABILITIES))(
    lambda t: st.quantiles(t, ["o_totalprice", "o_custkey"], accuracy=10_000_000)
)


def _hist_sql(t: str, c: str, value: str | None = None) -> str:
    v = value or f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, round(lo + i * (hi - lo) / 10, 6) AS bin, count(v) AS count FROM (SELECT min({v}) AS lo, max({v}) AS hi FROM {t}) e CROSS JOIN generate_series(0, 9) g(i)
LEFT JOIN (SELECT {v} AS v FROM {t}) x ON least(floor((v - lo) / (hi - lo) * 10), 9) = i GROUP BY lo, hi, i"""


_ORDER_COLUMNS = (("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority"), ("o_orderdate",))
query("equal_width_histogram", "orders", oracle=" UNION ALL ".join(f"SELECT * FROM ({_hist_sql('orders', c)})" for c in _ORDER_COLUMNS[0]))(lambda t: _rounded(st.histogram(t, list(_ORDER_COLUMNS[0])), "bin", places=6))
query("histogram_legacy", "lineitem", oracle=f"SELECT * FROM ({_hist_sql('lineitem', 'l_extendedprice', 'coalesce(l_extendedprice, 0.0)')})")(lambda t: _rounded(st.histogram(t, ["l_extendedprice"], nulls_as_zero=True), "bin", places=6))


_LIKELY = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax")


@query("frequent_items_sketch", "lineitem", oracle=" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS item, TRUE AS found FROM lineitem GROUP BY {c} HAVING count(*) >= {1 / st.TOP_ITEMS} * (SELECT count(*) FROM lineitem)" for c in _LIKELY))
def _sketch(t: DataFrame) -> DataFrame:
    """Every item that a sketch must name is among the candidates, in columns of two to fifty values."""
    found = st.frequent_candidates(t, list(_LIKELY)).withColumn("found", F.lit(True))
    return st.frequent_items(t, list(_LIKELY), 1 / st.TOP_ITEMS).join(found, ["column_name", "item"], "left").select("column_name", "item", F.coalesce("found", F.lit(False)).alias("found"))


query("frequent_items_5pct", "orders", oracle="SELECT * FROM (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS item, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_custkey', CAST(o_custkey AS STRING), count(*) FROM orders GROUP BY 2) WHERE count >= 0.05 * (SELECT count(*) FROM orders)")(
    lambda t: st.frequent_items(t, ["o_orderpriority", "o_custkey"], 0.05)
)
query("string_top20", "documents", oracle="SELECT source AS item, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(lambda t: st.top_strings(t, "source"))
query("multi_column_aggregate", "lineitem", oracle=" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(CAST(sum({c}) AS DOUBLE), 2) AS sum FROM lineitem" for c in _NUM))(
    lambda t: _rounded(st.aggregate_columns(t, _NUM, ["null_count", "non_null_count", "min", "max", "sum"]), "sum", places=2)
)
query("table_profile_full", "lineitem")(st.profile)
_LINE_COLUMNS = (tuple(_NUM), ("l_returnflag", "l_linestatus"), ("l_shipdate",))


def _exact_profile_sql(t: str, numeric: tuple[str, ...], strings: tuple[str, ...], others: tuple[str, ...], bins: bool = True) -> str:
    """Zero is added so that -0.0, which the tables hold, is 0.0."""
    counts = (("non_null_count", "count({c})"), ("null_count", "count(*) - count({c})"))
    numbers = (("mean", "avg({c})"), ("stddev", "stddev_samp({c})"), ("min", "min({c})"), ("max", "max({c})"))
    lengths = tuple((f"{m}_length", f"{f}(coalesce(length({{c}}), 0))") for m, f in (("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max")))
    wanted = [(c, m, x) for cs, ms in (((*numeric, *strings, *others), counts), (numeric, numbers), (strings, lengths)) for c in cs for m, x in ms]
    parts = [f"SELECT '{c}' AS column_name, '{m}' AS metric, round(CAST({x.format(c=c)} AS DOUBLE), 4) + 0.0 AS value FROM {t}" for c, m, x in wanted]
    parts += [f"SELECT column_name, 'bin ' || CAST(round(bin, 4) AS VARCHAR), CAST(count AS DOUBLE) FROM ({_hist_sql(t, c)})" for c in numeric if bins]
    return " UNION ALL ".join(parts)


def _exact_part(t: DataFrame) -> DataFrame:
    """All of the profile that is not an estimate: counts, moments and extremes of every column, and histograms."""
    return _rounded(st.profile(t).where(~F.col("metric").rlike("^(approx_distinct$|q[0-9]+$|item )")), "value", places=4)


query("table_profile", "orders", oracle=_exact_profile_sql("orders", *_ORDER_COLUMNS))(_exact_part)
query("table_profile_exact", "lineitem", oracle=_exact_profile_sql("lineitem", *_LINE_COLUMNS))(_exact_part)


def _ranks_hold(t: DataFrame, found: DataFrame, numeric: list[str], probabilities: tuple[float, ...], error: float) -> DataFrame:
    """(column_name, metric, within_bound): is the rank of each quantile (column_name, metric, value) what it should be, but for the error.

    The quantiles are columns of a written row, read beside each row of the table without a lookup; a few columns are counted at once, so that Spark compiles the aggregate."""
    names = [(c, f"q{round(p * 100)}", p) for c in numeric for p in probabilities]
    marks = F.broadcast(written(found.agg(*(F.max(F.when((F.col("column_name") == c) & (F.col("metric") == m), F.col("value"))).alias(f"{c}|{m}") for c, m, _ in names))))  # one row
    value = lambda c, m: F.col(f"`{c}|{m}`")

    def counted(some: list[str]) -> DataFrame:
        own = [(c, m) for c, m, _ in names if c in some]
        rows = t.select(*some).crossJoin(marks.select(*(value(c, m) for c, m in own)))
        return rows.agg(*(x for c, m in own for x in (F.count_if(F.col(c) < value(c, m)).alias(f"{c}|{m}|under"), F.count_if(F.col(c) <= value(c, m)).alias(f"{c}|{m}|upto"))), *(F.count(c).alias(f"{c}|n") for c in some))

    ranks = reduce(DataFrame.crossJoin, (counted(numeric[i : i + 2]) for i in range(0, len(numeric), 2)))  # one row each

    def holds(c: str, m: str, p: float) -> Column:
        n = F.col(f"`{c}|n`")
        return (F.col(f"`{c}|{m}|under`") <= n * (p + error) + 1) & (F.col(f"`{c}|{m}|upto`") >= n * (p - error) - 1)

    return ranks.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("metric"), holds(c, m, p).alias("within_bound")) for c, m, p in names))).alias("r")).select("r.*")


@query("table_profile_bounds", "lineitem", oracle=" UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, 'approx_distinct' AS metric, TRUE AS within_bound" for cs in _LINE_COLUMNS for c in cs]
    + [f"SELECT '{c}', 'q{round(p * 100)}', TRUE" for c in _LINE_COLUMNS[0] for p in st.PROBABILITIES]
    + [f"SELECT '{c}', 'item ' || CAST({c} AS VARCHAR), TRUE FROM lineitem GROUP BY {c} HAVING count(*) >= 0.05 * (SELECT count(*) FROM lineitem)" for c in (*_LINE_COLUMNS[1], "l_linenumber")]
))
def _profile_bounds(t: DataFrame) -> DataFrame:
    """The estimates of the profile against exact figures: distinct values, the ranks of quantiles, and that every item of 5 % of the rows
    is there with its count. Exact distinct counts make this a check and not a part of the profile."""
    columns, numeric, frequent = [c for cs in _LINE_COLUMNS for c in cs], list(_LINE_COLUMNS[0]), [*_LINE_COLUMNS[1], "l_linenumber"]
    profile = st.profile(t)
    exact = st.exact_distinct(t, columns)
    distinct = profile.where("metric = 'approx_distinct'").join(F.broadcast(exact), "column_name")
    distinct = distinct.select("column_name", "metric", (F.abs(F.col("value") - F.col("exact_distinct")) <= 3 * st.DISTINCT_ERROR * F.col("exact_distinct")).alias("within_bound"))

    quantiles = _ranks_hold(t, profile.where(F.col("metric").rlike("^q[0-9]+$")), numeric, st.PROBABILITIES, 1 / st.ACCURACY)
    items = profile.where("metric like 'item %'")
    due = st.frequent_items(t, frequent, 0.05).select("column_name", F.concat(F.lit("item "), "item").alias("metric"), "count")
    items = due.join(items, ["column_name", "metric"], "left").select("column_name", "metric", F.coalesce(F.col("value") == F.col("count"), F.lit(False)).alias("within_bound"))
    return st.union_metrics(distinct, quantiles, items)


@query("metrics_merge", "lineitem", oracle=" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(3 AS INT) AS n, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in _NUM))
def _merge(t: DataFrame) -> DataFrame:
    wide = st.aggregate_columns(t, _NUM, ["min", "max", "sum"])
    long = wide.select("column_name", F.stack(F.lit(3), F.lit("min"), "min", F.lit("max"), "max", F.lit("sum"), "sum").alias("metric", "value"))
    return st.merged_metrics(long).select("column_name", F.size("metrics").alias("n"), F.element_at("metrics", "max").alias("max"))


def _rollup_sql(keys: str, source: str, condition: str = "TRUE") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{d}' AS dim, CAST({d} AS STRING) AS value, count(*) AS count FROM ({source}) WHERE {d} IS NOT NULL AND {condition} GROUP BY ALL" for d in au.DIMENSIONS)


_HIVE = f"SELECT split_part(h, '.', 1) AS db, split_part(h, '.', 2) AS tbl, coalesce(requser, '') AS requser, access, action, result FROM (SELECT {_HTABLE} AS h, * FROM audit) WHERE h IS NOT NULL"
query("audit_hive_rollup", "audit", oracle=_rollup_sql("db, tbl", _HIVE))(lambda t: au.hive_rollup(t))
query("audit_hive_rollup_by_user", "audit", oracle=_rollup_sql("db, tbl, requser", _HIVE))(lambda t: au.hive_rollup(t, by_user=True))
query("audit_hdfs_rollup", "audit", oracle=_rollup_sql("resource, requser", "SELECT * FROM audit WHERE resource IS NOT NULL"))(lambda t: au.path_rollup(t, by_user=True))
_ACTIONS = f"SELECT {_HTABLE} AS htable, count(*) AS count, count(CASE WHEN action = 'select' THEN 1 END) AS selects, count(CASE WHEN action = 'create' THEN 1 END) AS creates, count(CASE WHEN action = 'drop' THEN 1 END) AS drops FROM audit GROUP BY 1 HAVING htable IS NOT NULL"
query("conditional_counts", "audit", oracle=_ACTIONS)(au.action_counts)
query("catalog_group_counts", "table_catalog", oracle="SELECT * FROM (SELECT 'db' AS kind, db AS value, count(*) AS count FROM table_catalog GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'inputformat', inputformat, count(*) FROM table_catalog GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'outputformat', outputformat, count(*) FROM table_catalog GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)")(
    lambda t: st.union_metrics(*(ca.group_counts(t, k).select(F.lit(k).alias("kind"), F.col(k).alias("value"), "count") for k in ("db", "inputformat", "outputformat")))
)
query("catalog_db_ranges", "table_catalog", oracle="SELECT db, max(size) AS max_size, min(size) AS min_size, max(numrows) AS max_rows, min(numrows) AS min_rows, max(numpartitions) AS max_parts, min(createtime) AS oldest FROM table_catalog GROUP BY db")(
    lambda t: t.groupBy("db").agg(F.max("size").alias("max_size"), F.min("size").alias("min_size"), F.max("numrows").alias("max_rows"), F.min("numrows").alias("min_rows"), F.max("numpartitions").alias("max_parts"), F.min("createtime").alias("oldest"))
)
_CELLS = ["email_cell", "ip_cell"]
_TWO = {"email": se.PATTERNS["email"], "ipaddress": se.PATTERNS["ipaddress"]}
_PII = "x AS (SELECT nullif(email_cell, '') AS email_cell, nullif(ip_cell, '') AS ip_cell FROM pii_cells)"


def _match_sql(labels: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS label, count(CASE WHEN regexp_full_match({c}, '{'|'.join(p)}') THEN 1 END) AS matches, count(*) - count({c}) AS nulls, count(*) AS total FROM x" for c in _CELLS for k, p in labels.items())


_cells = lambda t: t.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in _CELLS))
query("label_match_counts", "pii_cells", oracle=f"WITH {_PII} {_match_sql(_TWO)}")(lambda t: se.label_counts(_cells(t), _CELLS, _TWO))
query("label_match_counts_all", "pii_cells", oracle=f"WITH {_PII} {_match_sql(se.PATTERNS)}")(lambda t: se.label_counts(_cells(t), _CELLS, se.PATTERNS))
_PERCENT = f"{_PII}, m AS ({_match_sql(se.PATTERNS)}), p AS (SELECT *, CASE WHEN total > nulls THEN CAST(floor(matches * 100 / (total - nulls)) AS BIGINT) ELSE 0 END AS percent FROM m)"
_TOKENS = ", ".join(f"('{k}', '{t}')" for k, ts in se.KEYWORDS.items() for t in ts)
query("label_percent", "pii_cells", oracle=f"WITH {_PERCENT} SELECT * FROM p")(lambda t: se.label_percent(se.label_counts(_cells(t), _CELLS, se.PATTERNS)))
query("label_decision", "pii_cells", oracle=f"""WITH {_PERCENT}, k(label, token) AS (VALUES {_TOKENS}),
s AS (SELECT column_name, label, CAST(percent * 0.85 + CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.label = p.label AND contains(p.column_name, k.token)) THEN 15 ELSE 0 END AS DOUBLE) AS score FROM p)
SELECT column_name, label, score, 'suggested' AS status FROM s WHERE score > 70""")(
    lambda t: se.label_decisions(se.label_percent(se.label_counts(_cells(t), _CELLS, se.PATTERNS)), se.keyword_matches(t.sparkSession.createDataFrame([(c,) for c in _CELLS], "column_name string"), se.keyword_table(t.sparkSession)))
)
_SENS = [("database",), ("database", "label"), ("table_name",), ("table_name", "label")]


def _sens_sql(keys: tuple[str, ...]) -> str:
    return f"SELECT * FROM (SELECT '{'+'.join(keys)}' AS kind, {keys[0]} AS first_key, {keys[1] if len(keys) > 1 else 'NULL'} AS second_key, count(*) AS count FROM sensitivity GROUP BY ALL ORDER BY count DESC, first_key, second_key LIMIT 10)"


query("sensitivity_top_counts", "sensitivity", oracle=" UNION ALL ".join(map(_sens_sql, _SENS)))(
    lambda t: st.union_metrics(*(ca.group_counts(t, *k).select(F.lit("+".join(k)).alias("kind"), F.col(k[0]).alias("first_key"), (F.col(k[1]) if len(k) > 1 else F.lit(None).cast("string")).alias("second_key"), "count") for k in _SENS))
)
query("location_pair_counts", "points", oracle="SELECT city, country, count(*) AS count FROM points GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")(lambda t: geo.location_pairs(t, "city", "country"))
query("latlon_detect", "points", oracle="SELECT 'lat' AS column_name, CASE WHEN bool_and(lat BETWEEN -90 AND 90) THEN 'latitude' END AS kind FROM points UNION ALL SELECT 'lon', CASE WHEN bool_and(lon BETWEEN -90 AND 90) THEN 'latitude' WHEN bool_and(lon BETWEEN -180 AND 180) THEN 'longitude' END FROM points")(lambda t: geo.detect_coordinates(t.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")), ["lat", "lon"]))
query("kmeans_points", "points")(lambda t: geo.cluster_points(t))

# --- windows, sorts, sets
query("ntile_activity", "audit", oracle=f"SELECT htable, count, CAST(ntile(10) OVER (ORDER BY count, htable) AS INT) AS tile FROM ({_ACTIONS})")(au.activity_tiles)
query("latest_run", "run_history", oracle="SELECT assetid, profilerinstancename, id, status FROM (SELECT *, row_number() OVER (PARTITION BY assetid, profilerinstancename ORDER BY lastupdated DESC NULLS LAST, id DESC) AS k FROM run_history) WHERE k = 1")(lambda t: hi.last_run(t).select("assetid", "profilerinstancename", "id", "status"))
query("latest_version", "profiler_instances", "region", oracle=f"WITH {_LATEST_I} SELECT i.name, i.version, r.r_name FROM i JOIN region r ON r.r_regionkey = i.profilerid")(lambda i, r: hi.latest_versions(i).join(r, F.col("profilerid") == F.col("r_regionkey")).select("name", "version", "r_name"))
query("priority_dedupe_batches", "run_history", oracle="""WITH q AS (SELECT assetid, id, jobid % 7 AS priority, row_number() OVER (PARTITION BY assetid ORDER BY jobid % 7 DESC, id) AS k FROM run_history),
p AS (SELECT assetid, id, priority, row_number() OVER (ORDER BY priority DESC, id) AS place FROM q WHERE k = 1) SELECT assetid, id, priority, CAST(place AS INT) AS place, CAST(ceil(place / 10) AS INT) AS batch FROM p WHERE place <= 100""")(
    lambda t: hi.request_batches(t.select("assetid", "id", (F.col("jobid") % 7).alias("priority")))
)
query("topk_field", "audit", oracle="SELECT requser, count(*) AS count FROM audit WHERE action = 'select' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")(lambda t: au.top_k(t, "requser", 3, "action = 'select'"))
for _name, _by in (("catalog_top_size", "size"), ("catalog_top_rows", "numrows"), ("catalog_top_partitions", "numpartitions"), ("catalog_newest", "createtime")):
    query(_name, "table_catalog", oracle=f"SELECT table_name, {_by} FROM table_catalog ORDER BY {_by} DESC, table_name LIMIT 10")(lambda t, by=_by: ca.top_tables(t, by))
query("paginate_sorted", "jobs", oracle="SELECT id, status, start FROM jobs ORDER BY start DESC, id LIMIT 20 OFFSET 40")(lambda t: hi.paginate(t, ("id", "start", "status"), "start", True, 40, 20).select("id", "status", "start"))
query("paginate_filtered", "jobs", oracle="SELECT id, submitter, queue FROM jobs WHERE submitter = 's1' AND queue = '1-URGENT' ORDER BY id LIMIT 15 OFFSET 5")(lambda t: hi.paginate(hi.filter_rows(t, submitter=["s1"], queue=["1-URGENT"]), ("id",), "id", False, 5, 15).select("id", "submitter", "queue"))
query("union_metadata", "table_catalog", oracle="SELECT db, table_name, size FROM table_catalog")(lambda t: st.union_metrics(*(t.where(F.col("db") == f"db{i}").select("db", "table_name", "size") for i in range(5))).coalesce(5))
query("missing_tag_types", "sensitivity", oracle="SELECT DISTINCT label FROM sensitivity EXCEPT SELECT label FROM sensitivity WHERE database = 'db1'")(lambda t: t.select("label").distinct().subtract(t.where("database = 'db1'").select("label")))
query("distinct_assets", "sensitivity", oracle="SELECT DISTINCT database, table_name FROM sensitivity")(lambda t: t.select("database", "table_name").distinct())
query("union_metrics", "lineitem", oracle=" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{m}' AS metric, CAST({x}({c}) AS DOUBLE) AS value FROM lineitem" for c in ("l_quantity", "l_tax") for m, x in (("max", "max"), ("non_null_count", "count"))))(
    lambda t: st.union_metrics(*(st.aggregate_columns(t, ["l_quantity", "l_tax"], [m]).select("column_name", F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("max", "non_null_count")))
)


# --- extension points
@query("custom_aggregate", "lineitem", oracle="SELECT 'l_quantity' AS column_name, round(sum(l_quantity * l_quantity), 2) AS energy FROM lineitem UNION ALL SELECT 'l_tax', round(sum(l_tax * l_tax), 2) FROM lineitem")
def _custom(t: DataFrame) -> DataFrame:
    st.register_aggregate("energy", lambda c: F.round(F.sum(c * c), 2))
    return st.aggregate_columns(t, ["l_quantity", "l_tax"], ["energy"])


def _daily_states(t: DataFrame) -> DataFrame:
    """States of five parts of lineitem, as of five days, written one beside the other."""
    return written(mg.states(t.withColumn("day", F.col("l_orderkey") % 5), "day"))


@query("profile_merged", "lineitem", oracle=_exact_profile_sql("lineitem", *_LINE_COLUMNS, bins=False))
def _profile_merged(t: DataFrame) -> DataFrame:
    """The profiles of five days, kept and merged: all that is exact, against the whole table."""
    found = mg.finished(mg.merged(_daily_states(t)))
    return _rounded(found.where(~F.col("metric").rlike("^(approx_distinct|q[0-9]+)$")), "value", places=4)


@query("profile_merged_bounds", "lineitem", oracle=" UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, 'approx_distinct' AS metric, TRUE AS within_bound" for cs in _LINE_COLUMNS for c in cs]
    + [f"SELECT '{c}', 'q{round(p * 100)}', TRUE" for c in _LINE_COLUMNS[0] for p in mg.QUANTILES]
    + [f"SELECT '{c}', 'item ' || CAST({c} AS VARCHAR), TRUE FROM lineitem GROUP BY {c} HAVING count(*) >= 0.05 * (SELECT count(*) FROM lineitem)" for c in (*_LINE_COLUMNS[1], "l_linenumber")]
))
def _merged_bounds(t: DataFrame) -> DataFrame:
    """What is estimated in merged profiles, within the bounds of its sketches: distinct values, ranks of quantiles, and frequent items."""
    columns, frequent = [c for cs in _LINE_COLUMNS for c in cs], [*_LINE_COLUMNS[1], "l_linenumber"]
    whole = written(mg.merged(_daily_states(t)))
    found = mg.finished(whole)
    exact = st.exact_distinct(t, columns)
    distinct = found.where("metric = 'approx_distinct'").join(F.broadcast(exact), "column_name")  # a row a column
    distinct = distinct.select("column_name", "metric", (F.abs(F.col("value") - F.col("exact_distinct")) <= 4 * mg.DISTINCT_ERROR * F.col("exact_distinct") + 1).alias("within_bound"))
    quantiles = _ranks_hold(t, found.where(F.col("metric").rlike("^q[0-9]+$")), list(_LINE_COLUMNS[0]), mg.QUANTILES, mg.RANK_ERROR)
    due = st.frequent_items(t, frequent, 0.05).select("column_name", "item", F.col("count").alias("exact"))
    items = due.join(mg.frequent(whole), ["column_name", "item"], "left").select("column_name", F.concat(F.lit("item "), "item").alias("metric"), F.coalesce(F.col("count") == F.col("exact"), F.lit(False)).alias("within_bound"))
    return st.union_metrics(distinct, quantiles, items)


def _add(state, values):
    import pyarrow.compute as pc

    v = pc.drop_null(values.cast("float64"))
    v = v.filter(pc.not_equal(v, 0.0))
    return {"n": state["n"] + len(v), "s": state["s"] + (pc.sum(pc.divide(1.0, v)).as_py() or 0.0)}


#: An aggregator that Spark lacks, folded in Python: the harmonic mean of values that are not 0.
HARMONIC = mg.Folding("struct<n:bigint,s:double>", lambda: {"n": 0, "s": 0.0}, _add, lambda a, b: {"n": a["n"] + b["n"], "s": a["s"] + b["s"]}, lambda s: s["n"] / s["s"] if s["s"] else None)


@query("custom_folding", "lineitem", oracle=" UNION ALL ".join(f"SELECT '{c}' AS column_name, 'harmonic' AS metric, round(count(v) / sum(1 / v), 6) AS value FROM (SELECT nullif(CAST({c} AS DOUBLE), 0) AS v FROM lineitem)" for c in _NUM))
def _folding(t: DataFrame) -> DataFrame:
    """An aggregator of one's own over five days, each folded and kept, then merged."""
    days = [written(mg.folded(t.where(F.col("l_orderkey") % 5 == d), _NUM, HARMONIC).withColumn("day", F.lit(d))) for d in range(5)]
    kept = st.union_metrics(*days)
    return _rounded(mg.finished_folds(mg.merged_folds(kept, HARMONIC), HARMONIC, "harmonic"), "value", places=6)


_OWN = '[{"label":"corp_mail","type":"regex","patterns":["[a-z.0-9]+@mail[0-9]+[.]example[.]com"],"isEnabled":true},{"label":"off","type":"regex","patterns":["x"],"isEnabled":false}]'
query("custom_label_set", "pii_cells", oracle=f"WITH {_PII} SELECT 'email_cell' AS column_name, 'corp_mail' AS label, count(CASE WHEN regexp_full_match(email_cell, '[a-z.0-9]+@mail[0-9]+[.]example[.]com') THEN 1 END) AS matches, count(*) - count(email_cell) AS nulls, count(*) AS total FROM x")(lambda t: se.label_counts(_cells(t), ["email_cell"], se.read_labels(_OWN)))
query("custom_keyword_set", "column_list", oracle="SELECT DISTINCT column_name, 'money' AS label FROM column_list WHERE contains(column_name, 'amount') OR contains(column_name, 'price')")(lambda t: se.keyword_matches(t.select("column_name").distinct(), se.keyword_table(t.sparkSession, {"money": ["amount", "price"]})))
query("sql_query_job", "audit", oracle="SELECT requser, action, count(*) AS n FROM audit GROUP BY 1, 2")(lambda t: au.sql_job(t, "audit_view", "SELECT requser, action, count(*) AS n FROM audit_view GROUP BY requser, action"))


@query("query_dispatch", "audit", oracle="SELECT 'top' AS name, requser AS key, count(*) AS count FROM audit GROUP BY 2 UNION ALL SELECT 'paths', resource, count(*) FROM audit WHERE resource IS NOT NULL AND action IS NOT NULL GROUP BY 2")
def _dispatch(t: DataFrame) -> DataFrame:
    out = au.dispatch(t, [{"name": "top", "type": "TopKUsers", "params": {"field": "requser", "k": 100}}, {"name": "paths", "type": "HdfsRangerAggregate"}])
    paths = out["paths"].where("dim = 'action'").groupBy("resource").agg(F.sum("count").alias("count"))
    return out["top"].select(F.lit("top").alias("name"), F.col("requser").alias("key"), "count").unionByName(paths.select(F.lit("paths").alias("name"), F.col("resource").alias("key"), "count"))


