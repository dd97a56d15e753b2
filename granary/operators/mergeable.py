"""Statistics that can be kept and merged: the profile of a month from the profiles of its days, without the rows.

An aggregator has four parts: ``zero`` (the state of no rows), ``update`` (rows to state), ``merge`` (states to a state) and ``finish`` (a state to
metrics). Built-in ones are Spark aggregates on both ways; sketches stand for distinct values, quantiles and frequent items. One's own may be of
that kind (``Aggregator``) or fold Arrow arrays in Python (``Folding``).

``states`` gives a row a group and column, with a column for each aggregator; it is a table to be written each day. ``merged`` brings any of
these together, by any grouping, and ``finished`` reads the metrics off. States are small and of bounded size, and both steps combine before the
shuffle, so a year of daily states of a wide table merges in one small job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import columns_of

#: Values that a quantile sketch keeps at its lowest level; ranks are off by less than 0.3 % (with a chance of 99 %).
RANK_VALUES, RANK_ERROR = 2048, 0.003
#: log2 of the registers of a distinct count; its error is about 1.04 / sqrt(registers).
DISTINCT_BITS, DISTINCT_ERROR = 12, 0.0163
ITEMS, COUNTERS = 20, 256
QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)


@dataclass(frozen=True)
class Aggregator:
    """``kinds``: classes of columns it is for (numeric, string, boolean, undefined). ``update`` is an aggregate of a column of
    values, ``merge`` one of the column of states with that name, in which nulls (of columns of other classes) count for nothing; ``finish`` gives (metric,
    value) columns of a state that is not null."""

    kinds: tuple[str, ...]
    state: str
    update: Callable[[Column], Column]
    merge: Callable[[str], Column]
    finish: Callable[[Column], list[tuple[str, Column]]]


def _double(c: Column) -> Column:
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


def _moments(v: Column) -> Column:
    """(n, mean, m2), of which m2 is the sum of squared distances from the mean."""
    return F.struct(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))


def _merged_moments(s: str) -> Column:
    n, mean, m2 = (F.col(f"{s}.{x}") for x in ("n", "mean", "m2"))
    total = F.sum(n)
    centre = F.coalesce(F.sum(n * mean) / F.nullif(total, F.lit(0)), F.lit(0.0))
    return F.struct(F.coalesce(total, F.lit(0)).alias("n"), centre.alias("mean"), F.coalesce(F.greatest(F.sum(m2 + n * mean * mean) - total * centre * centre, F.lit(0.0)), F.lit(0.0)).alias("m2"))


def _read_moments(prefix: str) -> Callable[[Column], list[tuple[str, Column]]]:
    def read(s: Column) -> list[tuple[str, Column]]:
        n = s.getField("n")
        return [(f"mean{prefix}", F.when(n > 0, s.getField("mean"))), (f"stddev{prefix}", F.when(n > 1, F.sqrt(s.getField("m2") / (n - 1))))]

    return read


def _ends(v: Column) -> Column:
    return F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))


def _merged_ends(s: str) -> Column:
    return F.struct(F.min(f"{s}.lo").alias("lo"), F.max(f"{s}.hi").alias("hi"))


def _summed(s: str, *fields: str) -> Column:
    return F.struct(*(F.coalesce(F.sum(f"{s}.{x}"), F.lit(0)).alias(x) for x in fields))


def _length(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)).cast("double")


_ALL = ("numeric", "string", "boolean", "undefined")
#: Registry by name; ``register`` adds to it.
AGGREGATORS: dict[str, Aggregator] = {
    "counts": Aggregator(
        _ALL, "struct<total:bigint,known:bigint>",
        lambda c: F.struct(F.count(F.lit(1)).alias("total"), F.count(c).alias("known")),
        lambda s: _summed(s, "total", "known"),
        lambda s: [("non_null_count", s.getField("known").cast("double")), ("null_count", (s.getField("total") - s.getField("known")).cast("double"))],
    ),
    "distinct": Aggregator(
        _ALL, "binary", lambda c: F.hll_sketch_agg(c.cast("string"), F.lit(DISTINCT_BITS)), lambda s: F.hll_union_agg(s, F.lit(True)),
        lambda s: [("approx_distinct", F.hll_sketch_estimate(s).cast("double"))],
    ),
    "moments": Aggregator(("numeric",), "struct<n:bigint,mean:double,m2:double>", lambda c: _moments(c.cast("double")), _merged_moments, _read_moments("")),
    "ends": Aggregator(("numeric",), "struct<lo:double,hi:double>", lambda c: _ends(c.cast("double")), _merged_ends, lambda s: [("min", s.getField("lo")), ("max", s.getField("hi"))]),
    "ranks": Aggregator(
        ("numeric",), "binary", lambda c: F.kll_sketch_agg_double(_double(c), F.lit(RANK_VALUES)), lambda s: F.expr(f"kll_merge_agg_double({s}, {RANK_VALUES})"),
        lambda s: [(f"q{round(p * 100)}", F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(p)))) for p in QUANTILES],
    ),
    "lengths": Aggregator(("string",), "struct<n:bigint,mean:double,m2:double>", lambda c: _moments(_length(c)), _merged_moments, _read_moments("_length")),
    "length_ends": Aggregator(("string",), "struct<lo:double,hi:double>", lambda c: _ends(_length(c)), _merged_ends, lambda s: [("min_length", s.getField("lo")), ("max_length", s.getField("hi"))]),
    "truths": Aggregator(
        ("boolean",), "struct<yes:bigint,no:bigint>",
        lambda c: F.struct(F.count_if(c).alias("yes"), F.count_if(~c).alias("no")),
        lambda s: _summed(s, "yes", "no"),
        lambda s: [("true_count", s.getField("yes").cast("double")), ("false_count", s.getField("no").cast("double"))],
    ),
    "items": Aggregator(
        _ALL, "struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>",
        lambda c: F.call_function("approx_top_k_accumulate", c.cast("string"), F.lit(COUNTERS)), lambda s: F.expr(f"approx_top_k_combine({s}, {COUNTERS}) FILTER (WHERE {s} IS NOT NULL)"),
        lambda s: [],  # a list and no number: see ``frequent``; the merge cannot do without any state, so all columns have one
    ),
}


def register(name: str, aggregator: Aggregator) -> None:
    """Adds an aggregator of one's own for tables to come."""
    AGGREGATORS[name] = aggregator


def _used(names: tuple[str, ...] | None) -> list[str]:
    return list(AGGREGATORS if names is None else names)


def states(df: DataFrame, *by: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """(by, column_name, state…): a row a group and column, from one aggregate over the rows. Aggregators that are not for a column are null there."""
    used = _used(names)
    columns = [(c, kind) for kind in _ALL for c in columns_of(df, kind) if c not in by]
    columns = [(c, kind) for c, kind in columns if not df.schema[c].dataType.typeName().startswith(("array", "map", "struct", "variant"))]
    key = lambda c: "`" + c.replace("`", "``") + "`"
    wide = df.groupBy(*map(key, by)).agg(*(AGGREGATORS[a].update(F.col(key(c))).alias(f"{i}_{a}") for i, (c, kind) in enumerate(columns) for a in used if kind in AGGREGATORS[a].kinds))
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), *((F.col(f"{i}_{a}") if kind in AGGREGATORS[a].kinds else F.lit(None)).cast(AGGREGATORS[a].state).alias(a) for a in used)) for i, (c, kind) in enumerate(columns)))
    return wide.select(*map(key, by), F.explode(each).alias("_r")).select(*map(key, by), "_r.*")


def merged(parts: DataFrame, *by: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """States of several tables, days or groups as one a column (and group)."""
    used = [a for a in _used(names) if a in parts.columns]
    found = parts.groupBy(*by, "column_name").agg(*(AGGREGATORS[a].merge(a).alias(a) for a in used), *(F.count(a).alias(f"_has_{a}") for a in used))
    return found.select(*by, "column_name", *(F.when(F.col(f"_has_{a}") > 0, F.col(a)).alias(a) for a in used))  # a column's class decides which it has


def finished(parts: DataFrame, *by: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """(by, column_name, metric, value) of states."""
    rows = F.array_compact(F.flatten(F.array(*(F.array(*(F.when(F.col(a).isNotNull(), F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))) for m, v in found)) for a in _used(names) if a in parts.columns and (found := AGGREGATORS[a].finish(F.col(a)))))))
    return parts.select(*by, "column_name", F.explode(rows).alias("_r")).select(*by, "column_name", "_r.*")


def frequent(parts: DataFrame, *by: str, n: int = ITEMS) -> DataFrame:
    """(by, column_name, item, count): the most frequent items by their sketches, and what these estimate."""
    rows = parts.where("items is not null").select(*by, "column_name", F.explode(F.call_function("approx_top_k_estimate", F.col("items"), F.lit(n))).alias("_r"))
    return rows.select(*by, "column_name", "_r.item", "_r.count").where("item is not null")


@dataclass(frozen=True)
class Folding:
    """An aggregator in Python: ``zero()``, ``update(state, values)`` with an Arrow array, ``merge(a, b)``, ``finish(state)`` a number or None. A state is
    what Arrow keeps in a column of the SQL type ``state``; it must stay small, and merging must not depend on the order."""

    state: str
    zero: Callable[[], object]
    update: Callable[[object, pa.Array], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], float | None]


def folded(df: DataFrame, columns: list[str], f: Folding) -> DataFrame:
    """(column_name, state): a row a column and task; no row is shuffled."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [f.zero() for _ in names]
        for b in batches:
            found = [f.update(s, b.column(i)) for i, s in enumerate(found)]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found)], names=["column_name", "state"])

    return df.select(*("`" + c.replace("`", "``") + "`" for c in names)).mapInArrow(run, f"column_name string, state {f.state}")


def merged_folds(parts: DataFrame, f: Folding, *by: str, fan: int = 1000) -> DataFrame:
    """(by, column_name, state): one a column and group. States meet in groups of about ``fan`` at first, so however many tasks
    or days there are, no task gets all states of a column."""
    schema = parts.select(*by, "column_name", "state").schema

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1].copy()
        out.at[out.index[0], "state"] = reduce(f.merge, rows["state"])
        return out[[*by, "column_name", "state"]]

    dealt = parts.withColumn("_deal", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(fan)))
    once = dealt.groupBy(*by, "column_name", "_deal").applyInPandas(lambda rows: join(rows.drop(columns="_deal")), schema)
    return once.groupBy(*by, "column_name").applyInPandas(join, schema)


def finished_folds(parts: DataFrame, f: Folding, metric: str, *by: str) -> DataFrame:
    """(by, column_name, metric, value) of states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([None if (x := f.finish(s.as_py())) is None else float(x) for s in b.column(b.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], values], names=[*by, "column_name", "value"])

    kinds = {x.name: x.dataType.simpleString() for x in parts.schema}
    out = parts.select(*by, "column_name", "state").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "column_name string", "value double"]))
    return out.select(*by, "column_name", F.lit(metric).alias("metric"), "value")
