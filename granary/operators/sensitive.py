"""Sensitive-data detection: labels from values by pattern and from column names by keyword, scored and merged with known tags."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.expr import whole_match

# IBAN structures of the public registry, by label prefix: country code and structure (n digits, a capital letters, c both).
IBANS = {
    "DEU": "DE 18n", "GBR": "GB 4a14n", "LVA": "LV 4a13c", "FIN": "FI 14n", "EST": "EE 16n", "PRT": "PT 21n", "SWE": "SE 20n", "NOR": "NO 11n",
    "CHE": "CH 5n12c", "BGR": "BG 4a6n8c", "POL": "PL 24n", "IRL": "IE 4a14n", "LTU": "LT 16n", "SVN": "SI 15n", "DNK": "DK 14n", "SVK": "SK 20n",
    "MLT": "MT 4a5n18c", "LUX": "LU 3n13c", "LIE": "LI 5n12c", "FRA": "FR 10n11c2n", "HUN": "HU 24n", "AUT": "AT 16n", "ITA": "IT 1a10n12c",
    "CYP": "CY 8n16c", "ISL": "IS 22n", "HRV": "HR 17n", "CZE": "CZ 20n", "ESP": "ES 20n", "GRC": "GR 7n16c", "NLD": "NL 4a10n", "ROU": "RO 4a16c", "BEL": "BE 12n",
}
# Passport formats by country.
PASSPORTS = {
    "IRL": "[A-Z]{2}[0-9]{7}", "FIN": "[A-Z]{2}[0-9]{7}", "AUT": "[A-Z][0-9]{7}", "ITA": "[A-Z]{2}[0-9]{7}", "POL": "[A-Z]{2}[0-9]{7}", "GRC": "[A-Z]{2}[0-9]{7}",
    "DEU": "[CFGHJK][0-9CFGHJKLMNPRTVWXYZ]{8}", "ESP": "[A-Z]{2,3}[0-9]{6}", "CHE": "[A-Z][0-9]{7}", "FRA": "[0-9]{2}[A-Z]{2}[0-9]{5}", "BEL": "[A-Z]{2}[0-9]{6}",
}


_MONTH, _DAY = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_YMD, _DMY = f"[0-9]{{2}}{_MONTH}{_DAY}", f"{_DAY}{_MONTH}[0-9]{{2}}"
# National identity numbers by country, from their public descriptions. Women's months are 50 more in CZE and SVK; later
# centuries' 20 or 40 more in BGR. POL takes births before 2000 only: the acceptance values call a later month no identity number.
NATIONAL_IDS = {
    "CZE": f"[0-9]{{2}}(?:[05][1-9]|[16][0-2]|[27][1-9]|[38][0-2]){_DAY}/?[0-9]{{4}}",
    "SWE": f"(?:19|20)?{_YMD}[-+]?[0-9]{{4}}",
    "BGR": f"[0-9]{{2}}(?:[024][1-9]|[135][0-2]){_DAY}[0-9]{{4}}",
    "SVK": f"[0-9]{{2}}(?:[05][1-9]|[16][0-2]){_DAY}/?[0-9]{{4}}",
    "DNK": f"{_DMY}-?[0-9]{{4}}",
    "LVA": f"(?:{_DMY}|32[0-9]{{4}})-?[0-9]{{5}}",
    "PRT": "[0-9]{8}[ -]?[0-9] ?[A-Z0-9]{2}[0-9]",
    "EST": f"[1-8]{_YMD}[0-9]{{4}}",
    "POL": f"{_YMD}[0-9]{{5}}",
    "ISL": f"{_DMY}-?[0-9]{{3}}[089]",
    "ROU": f"[1-9]{_YMD}(?:0[1-9]|[1-3][0-9]|4[0-8]|5[12])[0-9]{{4}}",
    "LTU": f"[1-6]{_YMD}[0-9]{{4}}",
    "CHE": r"756\.?[0-9]{4}\.?[0-9]{4}\.?[0-9]{2}",
    "FIN": f"{_DMY}[-+A-FU-Y](?:00[2-9]|0[1-9][0-9]|[1-8][0-9]{{2}})[0-9A-FHJ-NPR-Y]",
    "ESP": "(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-HJ-NP-TV-Z]",
    "ITA": "[A-Z]{6}[0-9]{2}[A-EHLMPR-T](?:[04][1-9]|[1256][0-9]|[37][01])[A-Z][0-9]{3}[A-Z]",
    "IRL": "[0-9]{7}[A-W][A-IW]?",
    "GRC": "[A-Z]{1,2}-?[0-9]{6}",
    "NOR": f"{_DMY}[0-9]{{5}}",
}
# Names of countries in column names.
COUNTRIES = {
    "DEU": ["Germany"], "GBR": ["United Kingdom"], "LVA": ["Latvia"], "FIN": ["Finland"], "EST": ["Estonia"], "PRT": ["Portugal"], "SWE": ["Sweden"], "NOR": ["Norway"],
    "CHE": ["Switzerland"], "BGR": ["Bulgaria"], "POL": ["Poland"], "IRL": ["Ireland"], "LTU": ["Lithuania"], "SVN": ["Slovenia"], "DNK": ["Denmark"], "SVK": ["Slovakia"],
    "MLT": ["Malta"], "LUX": ["Luxembourg"], "LIE": ["Liechtenstein"], "FRA": ["France"], "HUN": ["Hungary"], "AUT": ["Austria"], "ITA": ["Italy"],
    "CYP": ["Cyprus"], "ISL": ["Iceland"], "HRV": ["Croatia"], "CZE": ["Czech Republic", "Czechia"], "ESP": ["Spain"], "GRC": ["Greece"], "NLD": ["Netherlands"], "ROU": ["Romania"], "BEL": ["Belgium"],
}


def _iban(structure: str) -> str:
    import re

    country, rest = structure.split()
    return country + "[0-9]{2}" + "".join(f"{ {'n': '[0-9]', 'a': '[A-Z]', 'c': '[A-Z0-9]'}[k]}{{{n}}}" for n, k in re.findall(r"(\d+)([nac])", rest))


#: label -> patterns of a whole value
PATTERNS: dict[str, list[str]] = {
    "creditcard": ["4[0-9]{12}(?:[0-9]{3})?", "5[1-5][0-9]{14}", "3[47][0-9]{13}", "6(?:011|5[0-9]{2})[0-9]{12}"],
    "email": [r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"],
    "name": ["[A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){0,3}"],
    "telephone": ["[0-9]{3}-[0-9]{3}-[0-9]{4}", r"\+?[0-9]{10,12}", r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}"],
    "ipaddress": [r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"],
    "ssn": ["(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})"],
    **{f"{k}_IBAN_Detection": [_iban(v)] for k, v in IBANS.items()},
    "IBAN_Detection": [_iban(v) for v in IBANS.values()],
    **{f"{k}_Passport_Detection": [v] for k, v in PASSPORTS.items()},
    "Passport_Detection": sorted(set(PASSPORTS.values())),
    **{f"{k}_NationalID_Detection": [v] for k, v in NATIONAL_IDS.items()},
    "NationalID_Detection": sorted(set(NATIONAL_IDS.values())),
}
# Words by which column names tell a label.
KEYWORDS = {
    "creditcard": ["creditcard", "ccnumber"], "ssn": ["ssn", "ssnnumber", "ssnno"], "address": ["address", "addr"], "email": ["emailaddress", "emailaddr", "email"],
    "name": ["name", "firstname", "lastname"], "latitude": ["lat", "latitude"], "longitude": ["long", "longitude"], "npi": ["npi"], "url": ["url"],
    "telephone": ["telephone", "tel"], "swiftcode": ["swiftcode"], "passport": ["passport", "passportnumber"], "ipaddress": ["ipaddress", "ipaddr", "ip"],
    "bankaccount": ["bankaccount", "account", "accountnumber"], "cvv": ["cvv"], "mrn": ["mrn"], "height": ["height"], "weight": ["weight"], "IBAN_Detection": ["IBAN", "International Bank Account Number"],
    "Passport_Detection": ["Passport Number"], "NationalID_Detection": ["National ID", "National identification number"],
}
for _kind, _known in (("IBAN_Detection", IBANS), ("Passport_Detection", PASSPORTS), ("NationalID_Detection", NATIONAL_IDS)):
    KEYWORDS |= {f"{k}_{_kind}": [f"{country} {token}" for country in COUNTRIES[k] for token in KEYWORDS[_kind]] for k in _known}
REGEX_WEIGHT, NAME_WEIGHT, THRESHOLD = 85, 15, 70


def read_labels(text: str) -> dict[str, list[str]]:
    """Enabled labels and patterns of a JSON list of {label, type, patterns, isEnabled}; only regex labels are known."""
    out = {}
    for x in json.loads(text):
        if x["type"] != "regex":
            raise ValueError(f"unknown label type {x['type']}")
        if x.get("isEnabled", True):
            out[x["label"]] = x["patterns"]
    return out


def keyword_table(spark: SparkSession, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, ts in keywords.items() for t in ts], "label string, token string")


def keyword_matches(columns: DataFrame, keywords: DataFrame, name: str = "column_name") -> DataFrame:
    """Distinct (name, label) where the name contains a token of the label; case counts. Keywords are configuration, so they are broadcast."""
    return columns.join(F.broadcast(keywords), F.contains(F.col(name), F.col("token"))).select(name, "label").distinct()


def label_counts(df: DataFrame, columns: list[str], labels: dict[str, list[str]]) -> DataFrame:
    """(column_name, label, matches, nulls, total), from one scan and one aggregate however many columns and labels there are.

    Values are unpivoted as text beside their column's name, so the plan has an expression a label and not one a column and label; what is
    shuffled is one row of counts a column and task."""
    names = list(labels)
    values = df.select(*(F.col("`" + c.replace("`", "``") + "`").cast("string").alias(f"c{i}") for i, c in enumerate(columns))).unpivot([], [f"c{i}" for i in range(len(columns))], "column", "value")
    counts = values.groupBy("column").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value").isNull()).alias("nulls"), *(F.count_if(whole_match(F.col("value"), labels[k])).alias(f"n{i}") for i, k in enumerate(names)))
    every = df.sparkSession.createDataFrame([(f"c{i}", c) for i, c in enumerate(columns)], "column string, column_name string")
    rows = F.array(*(F.struct(F.lit(k).alias("label"), F.coalesce(f"n{i}", F.lit(0)).alias("matches")) for i, k in enumerate(names)))
    whole = every.join(counts, "column", "left")  # a row a column, also of an empty table
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return whole.select("column_name", F.explode(rows).alias("r"), zero("nulls"), zero("total")).select("column_name", "r.label", "r.matches", "nulls", "total")


def label_percent(counts: DataFrame) -> DataFrame:
    """Whole percent of matches among values that are not null; 0 where all are."""
    known = F.col("total") - F.col("nulls")
    return counts.withColumn("percent", F.when(known > 0, F.floor(F.col("matches") * 100 / known)).otherwise(0).cast("bigint"))


def label_decisions(percent: DataFrame, named: DataFrame, regex_weight: int = REGEX_WEIGHT, name_weight: int = NAME_WEIGHT, threshold: int = THRESHOLD) -> DataFrame:
    """(column_name, label, score, status) of labels whose weighed score is over the threshold."""
    by_name = named.select("column_name", "label").distinct().withColumn("named", F.lit(True))
    score = F.col("percent") * regex_weight / 100 + F.when(F.col("named"), name_weight).otherwise(0)
    return percent.join(by_name, ["column_name", "label"], "left").withColumn("score", score.cast("double")).where(F.col("score") > threshold).select("column_name", "label", "score", F.lit("suggested").alias("status"))


def merge_tags(new: DataFrame, known: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to commit, to store): suggestions not yet catalogued, on known columns; and those with the catalogued ones at 100 %."""
    fresh = new.join(known, ["column_name", "label"], "left_anti").join(columns.select("column_name", "column_id"), "column_name")
    stored = known.join(columns.select("column_name", "column_id"), "column_name").withColumn("percentmatch", F.lit(100.0))
    return fresh, fresh.select("column_name", "label", "percentmatch").unionByName(stored.select("column_name", "label", "percentmatch"))
