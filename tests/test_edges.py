"""Edge tables and properties of the profiling operators."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import expr
from granary.operators import audit, geo, history, sensitive, stats
from granary.sources import stores
from granary.sources.scratch import fresh_dir


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, float("nan")), (2.0, None, 5.0, 1.0), (None, None, 5.0, 3.0)], "a double, b double, c double, d double")
    got = {c: [(r.bin, r["count"]) for r in rows] for c in "abcd" if (rows := stats.histogram(df, list("abcd")).where(F.col("column_name") == c).orderBy("bin").collect()) is not None}
    assert sum(n for _, n in got["a"]) == 2 and len(got["a"]) == 10 and got["a"][-1][1] == 1
    assert got["b"] == [] and got["c"] == [(5.0, 3)]
    assert sum(n for _, n in got["d"]) == 2


def test_histogram_counts_sum_to_non_null(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = {r[0]: r[1] for r in stats.histogram(df, ["l_quantity", "l_tax"]).groupBy("column_name").agg(F.sum("count")).collect()}
    assert set(got.values()) == {df.count()}


def test_profile_of_empty_and_single_row(spark):
    schema = "a int, s string, b boolean, d decimal(10,3), t smallint"
    empty = stats.profile(spark.createDataFrame([], schema)).where("metric = 'non_null_count'").collect()
    assert {r.value for r in empty} == {0.0}
    one = spark.createDataFrame([(1, 'q"😀', True, None, 3)], schema)
    rows = {(r.column_name, r.metric): r.value for r in stats.profile(one).collect()}
    assert rows["a", "q50"] == 1.0 and rows["s", "max_length"] == 3.0 and rows["b", "true_count"] == 1.0 and rows["t", "mean"] == 3.0


def test_profile_does_not_depend_on_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderpriority")
    exact = lambda d: sorted((r.column_name, r.metric, round(r.value, 6)) for r in stats.profile(d).collect() if not r.metric.startswith(("q", "approx")) and not (r.column_name == "o_custkey" and r.metric.startswith("item")))
    assert exact(df) == exact(df.repartition(7))


def test_json_text_escapes(spark):
    df = spark.createDataFrame([("c", 'a"b\n', 1)], "k string, item string, count int")
    assert stats.json_text(df, "k", ["item", "count"], "j").first().j == '[{"item":"a\\"b\\n","count":1}]'


def test_resource_without_slash_names_no_table(spark):
    df = spark.createDataFrame([("x", "@table"), ("d/t/c", "@column"), ("/p", "path"), (None, "@table")], "resource string, restype string")
    assert [r.htable for r in audit.with_table_name(df).collect()] == [None, "d.t", None, None]


def test_whole_match_is_not_fooled_by_newline(spark):
    df = spark.createDataFrame([("127.0.0.1",), ("127.0.0.1\n",), (None,)], "v string")
    assert [r[0] for r in df.select(expr.whole_match(F.col("v"), sensitive.PATTERNS["ipaddress"])).collect()] == [True, False, None]


# fixed acceptance values: label, must match, must not match
LABELS = [
    ("creditcard", ["5499180893080110", "4556354271809940"], ["123we", "$%%DFGDF"]),
    ("email", ["nancyjpowers@jourrapide.com"], ["ksfnkfn#$%$", "@djffdjf.ma"]),
    ("name", ["John", "Amir"], ["3482y3", "sekfnsr%"]),
    ("telephone", ["856-232-9702", "442071838750"], ["$2323ksmd", "4325"]),
    ("ipaddress", ["172.16.254.1", "127.0.0.1"], ["343.43.12.43", "$%232"]),
    ("ssn", ["427-43-1234", "711-21-5436"], ["000-12-5432", "912-12-4321", "321-432-2354", "7832-12-4325", "124-43-334534"]),
    ("DEU_IBAN_Detection", ["DE89370400440532013000"], ["BE89370400440532013"]),
    ("GBR_IBAN_Detection", ["GB29NWBK60161331926819"], ["ZZ89370400440532013"]),
    ("LVA_IBAN_Detection", ["LV80BANK0000435195001"], ["BE89370400440532013"]),
    ("MLT_IBAN_Detection", ["MT84MALT011000012345MTLCAST001S"], ["BE89370400440532013"]),
    ("FRA_IBAN_Detection", ["FR1420041010050500013M02606"], ["BE89370400440532013"]),
    ("HUN_IBAN_Detection", ["HU42117730161111101800000000"], ["BE89370400440532013"]),
    ("GRC_IBAN_Detection", ["GR1601101250000000012300695"], ["BE89370400440532013"]),
    ("ROU_IBAN_Detection", ["RO49AAAA1B31007593840000"], ["BE89370400440532013"]),
    ("BEL_IBAN_Detection", ["BE68539007547034"], ["BE89370400440532013"]),
    ("IBAN_Detection", ["NL91ABNA0417164300", "ES9121000418450200051332"], ["BE89370400440532013", "XX12334ABCD"]),
    ("IRL_Passport_Detection", ["XN5004216"], ["LN500432P"]),
    ("DEU_Passport_Detection", ["C01X00T47"], ["LN500432PA"]),
    ("ESP_Passport_Detection", ["AF238143"], ["LN500432P"]),
    ("FRA_Passport_Detection", ["05CK02237"], ["LN500432P"]),
    ("BEL_Passport_Detection", ["EH000001"], ["LN500432P"]),
    ("Passport_Detection", ["EH000001", "05CK02237", "C01X00T47", "AE0000005"], ["LN500432PA2"]),
    ("NOR_NationalID_Detection", ["29029900157"], ["89029900157"]),
    ("CZE_NationalID_Detection", ["7103192745"], ["590312123"]),
    ("SWE_NationalID_Detection", ["811228-9874"], ["811328-9873"]),
    ("BGR_NationalID_Detection", ["7523169263", "8032056031"], ["8019010008"]),
    ("SVK_NationalID_Detection", ["710319/2745"], ["710332/2746"]),
    ("DNK_NationalID_Detection", ["211062-5629"], ["511062-5629"]),
    ("LVA_NationalID_Detection", ["161175-19997"], ["161375-19997"]),
    ("PRT_NationalID_Detection", ["00000000-0ZZ4"], ["00000000-AZZ4"]),
    ("EST_NationalID_Detection", ["37605030299"], ["376050302999"]),
    ("POL_NationalID_Detection", ["83010411457", "87123116221"], ["04271113861"]),
    ("ISL_NationalID_Detection", ["120174-3399"], ["1201743397"]),
    ("ROU_NationalID_Detection", ["1630615123457", "1800101221199"], ["1630615983458"]),
    ("LTU_NationalID_Detection", ["38703181745"], ["38703421745"]),
    ("CHE_NationalID_Detection", ["756.1234.5678.95"], ["856.1234.5678.95"]),
    ("FIN_NationalID_Detection", ["311280-888Y"], ["131052-001U"]),
    ("ESP_NationalID_Detection", ["99999999R"], ["X-2482300A"]),
    ("ITA_NationalID_Detection", ["MRTMTT25D09F205Z", "MLLSNT82P65Z404U"], ["4RTMTT25D09F205Z"]),
    ("NationalID_Detection", ["MRTMTT25D09F205Z", "99999999R", "38703181745", "1800101221199"], ["4RTMTT25D09F205Z", "X-2482300A", "38703421745", "1630615983458"]),
]


def test_labels(spark):
    rows = [(label, v, want) for label, good, bad in LABELS for want, vs in ((True, good), (False, bad)) for v in vs]
    df = spark.createDataFrame(rows, "label string, v string, want boolean")
    for label in {r[0] for r in rows}:
        got = df.where(F.col("label") == label).withColumn("got", expr.whole_match(F.col("v"), sensitive.PATTERNS[label])).where("got <> want").collect()
        assert got == []


def test_keywords_name_countries(spark):
    columns = spark.createDataFrame([("Czechia National ID",), ("my Spain IBAN",), ("Ireland Passport Number",)], "column_name string")
    got = {tuple(r) for r in sensitive.keyword_matches(columns, sensitive.keyword_table(spark)).collect()}
    due = {("Czechia National ID", "CZE_NationalID_Detection"), ("Czechia National ID", "NationalID_Detection"), ("my Spain IBAN", "ESP_IBAN_Detection"), ("my Spain IBAN", "IBAN_Detection"),
           ("Ireland Passport Number", "IRL_Passport_Detection"), ("Ireland Passport Number", "Passport_Detection")}
    assert got == due


def test_selection(spark):
    """All choices of up to two filters on each side, against the rule told in plain Python."""
    names = ["apple", "avocado", "banana", "melon"]
    filters = {"every": (F.lit(True), lambda x: True), "no": (F.lit(False), lambda x: False), "unknown": (F.lit(None).cast("boolean"), lambda x: False), "with an": (F.col("id").contains("an"), lambda x: "an" in x)}
    choices = [c for n in range(3) for c in itertools.combinations(filters, n)]
    df = spark.createDataFrame([(x,) for x in names], "id string").coalesce(1).cache()
    for drop, pick in itertools.product(choices, choices):
        due = [x for x in names if not any(filters[f][1](x) for f in drop) and any(filters[f][1](x) for f in pick)]
        assert [r.id for r in history.select_assets(df, [filters[f][0] for f in drop], [filters[f][0] for f in pick]).collect()] == due, (drop, pick)


def test_points_near_poles_and_the_date_line(spark):
    """Cells of latitude and longitude lose no point, against all pairs."""
    rnd = random.Random(2)
    place = lambda: (rnd.choice([0, 45, 60, 85, 89.5, 90, -89.9, -70]) + rnd.uniform(-0.6, 0.6), rnd.choice([0, 90, 179.7, -179.8, 12]) + rnd.uniform(-0.8, 0.8))
    centers, points = [(i, *place()) for i in range(60)], [place() for _ in range(800)]
    c, p = spark.createDataFrame(centers, "id int, lat double, lon double"), spark.createDataFrame([*points, (None, 1.0)], "lat double, lon double")
    c, p = (x.where("lat is null or abs(lat) <= 90") for x in (c, p))
    both = c.crossJoin(p.select(F.col("lat").alias("y"), F.col("lon").alias("x"))).where(expr.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) < 100.0)
    due = {r.id: r["count"] for r in both.groupBy("id").count().collect()}
    assert {r.id: r.near for r in geo.points_near(c, p).where("near > 0").collect()} == due and sum(due.values()) > 100


def test_unknown_sort_column_and_types_are_errors(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        history.paginate(df, ("id",), "name", False, 0, 1)
    with pytest.raises(ValueError):
        sensitive.read_labels('[{"label":"x","type":"list","patterns":[]}]')
    with pytest.raises(ValueError):
        audit.dispatch(df, [{"name": "a", "type": "b"}])


def test_missing_audit_is_an_error_and_empty_days_are_skipped(spark):
    with pytest.raises(FileNotFoundError):
        stores.read_audit(spark, fresh_dir(spark, "nothing"), dt.date(2024, 1, 7), "weekly")


def test_compact_skips_an_empty_store(spark):
    source, target = fresh_dir(spark, "empty"), fresh_dir(spark, "target")
    spark.range(0).write.parquet(source)
    assert not stores.compact(spark, source, target) and stores.existing(spark, [target]) == []
