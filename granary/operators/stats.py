"""Column statistics: one wide aggregate for a whole table, a second pass for what needs the first."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources.scratch import written

PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 0.99)
BINS = 10
TOP_ITEMS, COUNTERS = 20, 200
ACCURACY = 10_000
DISTINCT_ERROR = 0.05


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Columns of a class: numeric, string, boolean or undefined (all else)."""

    def class_of(t: T.DataType) -> str:
        return "numeric" if isinstance(t, T.NumericType) else "string" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "undefined"

    return [f.name for f in df.schema if class_of(f.dataType) == kind]


def unpivoted(wide: DataFrame, columns: list[str], metrics: list[str]) -> DataFrame:
    """One row (column_name, metric…) for each column from fields named ``<column>|<metric>`` of a one-row frame, without a join or union."""
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}|{m}`").alias(m) for m in metrics)) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


#: Aggregates by name: a function of the column.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "non_null_count": F.count,
    "null_count": lambda c: F.count_if(c.isNull()),
    "mean": lambda c: F.avg(c.cast("double")),
    "stddev": lambda c: F.stddev_samp(c.cast("double")),
    "min": lambda c: F.min(c.cast("double")),
    "max": lambda c: F.max(c.cast("double")),
    "sum": lambda c: F.sum(c.cast("double")),
    "approx_distinct": lambda c: F.approx_count_distinct(c, DISTINCT_ERROR),
    "exact_distinct": F.count_distinct,
    "true_count": lambda c: F.count_if(c),
    "false_count": lambda c: F.count_if(~c),
    "mean_length": lambda c: F.avg(F.coalesce(F.length(c), F.lit(0))),
    "min_length": lambda c: F.min(F.coalesce(F.length(c), F.lit(0))).cast("bigint"),
    "max_length": lambda c: F.max(F.coalesce(F.length(c), F.lit(0))).cast("bigint"),
    "stddev_length": lambda c: F.stddev_samp(F.coalesce(F.length(c), F.lit(0))),
}


def register_aggregate(name: str, make: Callable[[Column], Column]) -> None:
    """Adds an aggregate of one's own; ``make`` may build on built-ins or call a grouped-aggregate pandas UDF."""
    AGGREGATES[name] = make


def aggregate_columns(df: DataFrame, columns: list[str], metrics: list[str]) -> DataFrame:
    """(column_name, metric…): all metrics of all columns in one pass with partial aggregation."""
    if not columns:
        return df.select(F.lit("").alias("column_name"), *(F.lit(None).cast("double").alias(m) for m in metrics)).limit(0)
    return unpivoted(df.agg(*(AGGREGATES[m](F.col(f"`{c}`")).alias(f"{c}|{m}") for c in columns for m in metrics)), columns, metrics)


def exact_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, exact_distinct): each column by itself, so that a shuffled row is one value; several distinct counts in one
    aggregate would make a row of all columns for each of them."""
    counts = [df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().agg(F.lit(c).alias("column_name"), F.count("v").alias("exact_distinct")) for c in columns]
    return union_metrics(*counts)


def quantiles(df: DataFrame, columns: list[str], probabilities: tuple[float, ...] = PROBABILITIES, accuracy: int = ACCURACY) -> DataFrame:
    """(column_name, quartile, value). An accuracy of 4 is a relative error of 0.25."""
    wide = df.agg(*(F.percentile_approx(F.col(c).cast("double"), list(probabilities), accuracy).alias(f"{c}|q") for c in columns))
    rows = unpivoted(wide, columns, ["q"]).where("q is not null")
    return rows.select("column_name", F.posexplode("q").alias("i", "value")).select("column_name", F.element_at(F.array(*map(F.lit, probabilities)), F.col("i") + 1).alias("quartile"), "value")


def _number(c: Column) -> Column:
    """A value of a histogram: null where it is NaN."""
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


def _place(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Number of the value's bin among ``bins`` equal ones on [lo, hi], the last closed; null without a value."""
    inside = F.when(hi > lo, F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return F.when(value.isNotNull(), inside).cast("int")  # least() alone would skip a null


def _bin_rows(counts: DataFrame, bins: int) -> DataFrame:
    """(column_name, bin, count) from (column_name, lo, hi, n): bins by their lower ends; a single one where lo = hi, none without values."""
    long = counts.where("lo is not null").select("column_name", "lo", "hi", F.posexplode("n").alias("i", "count"))
    return long.where("hi > lo or i = 0").select("column_name", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / bins).alias("bin"), "count")


def histogram(df: DataFrame, columns: list[str], bins: int = BINS, nulls_as_zero: bool = False) -> DataFrame:
    """(column_name, bin, count): ``bins`` equal bins on [min, max], the last closed, empty ones with 0; one bin where min = max.

    Columns that are all null have none; nulls and NaN are skipped, or count as 0 with ``nulls_as_zero``.
    """
    good = lambda c: F.coalesce(_number(F.col(f"`{c}`")), F.lit(0.0)) if nulls_as_zero else _number(F.col(f"`{c}`"))
    values = df.select(*(good(c).alias(f"v{i}") for i, c in enumerate(columns)))
    ends = values.agg(*(x for i in range(len(columns)) for x in (F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"))))
    rows = values.crossJoin(F.broadcast(ends))  # one row
    numbers = range(len(columns))
    counts = rows.agg(*(F.array(*(F.count_if(_place(F.col(f"v{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"), bins) == b) for b in range(bins))).alias(f"n{i}") for i in numbers), *(F.first(f"{e}{i}").alias(f"{e}{i}") for i in numbers for e in ("lo", "hi")))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)))
    return _bin_rows(counts.select(F.explode(each).alias("r")).select("r.*"), bins)


def item_sketch(column: str, top: int = TOP_ITEMS, counters: int = COUNTERS) -> Column:
    """The likely most frequent values of a column, in its own type, from a sketch of so many counters."""
    found = f"approx_top_k(`{column.replace('`', '``')}`, {top + 1}, {max(counters, top + 1)})"  # null is an item of the sketch
    return F.expr(f"slice(filter(transform({found}, x -> x.item), x -> x IS NOT NULL), 1, {top})")


def frequent_candidates(df: DataFrame, columns: list[str], top: int = TOP_ITEMS, counters: int = COUNTERS) -> DataFrame:
    """(column_name, item): likely frequent items as text, from sketches of ``counters`` counters in one pass."""
    sketches = df.agg(*(item_sketch(c, top, counters).cast("array<string>").alias(f"{c}|items") for c in columns))
    return unpivoted(sketches, columns, ["items"]).select("column_name", F.explode("items").alias("item")).where("item is not null").distinct()


def _candidate_counts(df: DataFrame, columns: list[str], top: int, counters: int) -> DataFrame:
    """(column_name, item, count, total): exact counts of the candidates of a sketch; ``total`` are all rows.

    Two scans: sketches, whose one row is written and broadcast, and counts. Of each row the second takes only the columns whose value is a candidate,
    by its number, so nothing is exploded or shuffled but small numbers, and these are combined before the shuffle."""
    numbers = range(len(columns))
    sketches = written(df.agg(F.count(F.lit(1)).alias("total"), *(item_sketch(c, top, counters).alias(f"items{i}") for i, c in enumerate(columns))))
    known = F.broadcast(sketches)  # one row
    stride = max(counters, top) + 1
    place = [F.array_position(f"items{i}", F.col(f"`{c}`")) for i, c in enumerate(columns)]
    hits = F.array_compact(F.array(*(F.when(p > 0, p + i * stride) for i, p in enumerate(place))))
    found = df.select(*(F.col(f"`{c}`") for c in columns)).crossJoin(known).select(F.explode(hits).alias("hit")).groupBy("hit").agg(F.count(F.lit(1)).alias("count"))

    def named(i: int) -> Column:
        return F.transform(F.col(f"items{i}").cast("array<string>"), lambda x, k: F.struct(F.lit(columns[i]).alias("column_name"), x.alias("item"), (k + 1 + i * stride).cast("bigint").alias("hit")))

    each = F.flatten(F.array(*map(named, numbers)))
    names = sketches.select("total", F.explode(each).alias("r")).select("total", "r.*").where("item is not null")
    return found.join(F.broadcast(names), "hit").select("column_name", "item", "count", "total")  # at most top rows a column


def exact_counts(df: DataFrame, columns: list[str], top: int = TOP_ITEMS, counters: int = COUNTERS) -> DataFrame:
    """(column_name, item, count): exact counts of the likely frequent items of each column."""
    return _candidate_counts(df, columns, top, counters).drop("total")


def frequent_items(df: DataFrame, columns: list[str], support: float) -> DataFrame:
    """(column_name, item, count) of all items with at least this share of the rows, exactly.

    A sketch of m counters names every item of more than 7/m of the rows, so eight counters for each 1/support miss none."""
    m = 8 * math.ceil(1 / support)
    return _candidate_counts(df, columns, m, m).where(F.col("count") >= F.col("total") * support).drop("total")


def top_strings(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).alias("item")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("item")).limit(n)


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _counted(place: str, values: int) -> str:
    """SQL for a map from small numbers to their counts. A sketch with room for far more than there are different values counts exactly."""
    return f"map_from_entries(transform(filter(approx_top_k({place}, {values + 1}, {4 * (values + 2)}), x -> x.item IS NOT NULL), x -> (x.item, x.count)))"


def profile(df: DataFrame, bins: int = BINS, top: int = TOP_ITEMS) -> DataFrame:
    """Long form (column_name, metric, value) of the whole profile: counts for every column, moments of numbers and lengths of
    strings, approximate distinct values, quantiles, histograms and frequent items.

    Two scans, whatever the number of columns: the first is one aggregate of counts, moments, quantile and item sketches, and leaves one row; the
    second, beside that row, counts bins and candidate items in one aggregate, of one expression a column for each. Neither explodes nor
    shuffles rows; the plan grows with the columns only. The one row is written.
    """
    flat = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    numeric, strings, booleans = (columns_of(df, k) for k in ("numeric", "string", "boolean"))
    kinds = {c: ["non_null_count", "null_count", "approx_distinct"] for c in flat}
    for cs, more in ((numeric, ["mean", "stddev", "min", "max"]), (strings, ["mean_length", "stddev_length", "min_length", "max_length"]), (booleans, ["true_count", "false_count"])):
        for c in cs:
            kinds[c] = kinds[c] + more
    number, listed = {c: i for i, c in enumerate(flat)}, [*numeric, *strings]
    values = df.select(*(F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for c, i in number.items()))
    aggregates = [AGGREGATES[m](F.col(f"c{number[c]}")).cast("double").alias(f"c{number[c]}_{m}") for c, ms in kinds.items() for m in ms]
    for i in (number[c] for c in numeric):
        v = _number(F.col(f"c{i}"))
        aggregates += [F.percentile_approx(F.col(f"c{i}").cast("double"), list(PROBABILITIES), ACCURACY).alias(f"c{i}_q"), F.min(v).alias(f"c{i}_lo"), F.max(v).alias(f"c{i}_hi")]
    aggregates += [item_sketch(f"c{number[c]}", top).alias(f"c{number[c]}_items") for c in listed]
    first = written(values.agg(*aggregates))

    def row(*fields: str) -> str:
        return f"named_struct({', '.join(f"'f{k}', {x}" for k, x in enumerate(fields))})"

    def inlined(rows: DataFrame, each: list[str], nested: bool = False) -> DataFrame:
        """Structs (or arrays of structs) of a one-row frame as rows."""
        return rows.selectExpr(f"inline({'flatten' * nested}(array({', '.join(each)}))) AS (column_name, metric, value)")

    parts = [inlined(first, [row(_quoted(c), f"'{m}'", f"c{number[c]}_{m}") for c, ms in kinds.items() for m in ms])] if flat else []
    if numeric:
        labels = "array(" + ", ".join(f"'q{round(p * 100)}'" for p in PROBABILITIES) + ")"
        parts.append(inlined(first, [f"transform(coalesce(c{number[c]}_q, array()), (v, k) -> {row(_quoted(c), f'{labels}[k]', 'v')})" for c in numeric], nested=True))
    if listed:
        known = first.select(*(f"c{number[c]}_{x}" for c in numeric for x in ("lo", "hi")), *(f"c{number[c]}_items" for c in listed))
        rows = values.select(*(f"c{number[c]}" for c in listed)).crossJoin(F.broadcast(known))  # one row
        places = [_place(_number(F.col(f"c{i}")), F.col(f"c{i}_lo"), F.col(f"c{i}_hi"), bins).alias(f"c{i}_bin") for i in (number[c] for c in numeric)]
        places += [F.array_position(f"c{i}_items", F.col(f"c{i}")).cast("int").alias(f"c{i}_item") for i in (number[c] for c in listed)]
        counts = [F.expr(_counted(f"c{number[c]}_bin", bins)).alias(f"c{number[c]}_bins") for c in numeric] + [F.expr(_counted(f"c{number[c]}_item", top)).alias(f"c{number[c]}_counts") for c in listed]
        second = rows.select(*places).agg(*counts).crossJoin(F.broadcast(known))  # one row each
        each = [f"transform(CASE WHEN c{i}_lo IS NULL THEN array() WHEN c{i}_hi > c{i}_lo THEN sequence(0, {bins - 1}) ELSE array(0) END, b -> {row(_quoted(c), f"concat('bin ', CAST(round(c{i}_lo + b * (c{i}_hi - c{i}_lo) / {bins}, 4) AS STRING))", f'CAST(coalesce(try_element_at(c{i}_bins, b), 0L) AS DOUBLE)')})" for c in numeric for i in (number[c],)]
        each += [f"transform(CAST(c{i}_items AS array<string>), (x, k) -> {row(_quoted(c), "concat('item ', x)", f'CAST(coalesce(try_element_at(c{i}_counts, k + 1), 0L) AS DOUBLE)')})" for c in listed for i in (number[c],)]
        parts.append(inlined(second, each, nested=True))
    return union_metrics(*parts) if parts else df.sparkSession.createDataFrame([], "column_name string, metric string, value double")


def union_metrics(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_metrics(long: DataFrame) -> DataFrame:
    """(column_name, metrics): one map a column from (column_name, metric, value)."""
    return long.groupBy("column_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def json_text(rows: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """(key, name): the rows of each key as JSON text, in the order of ``fields``."""
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias(name))
