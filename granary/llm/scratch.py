"""Written intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a batch after which freed memory is given back.
_LARGE = 1 << 22
#: Deletes the shuffle files of a query at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Without one, a folder of this machine serves a local master; other machines could
    not see it, so there the setting is asked for."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts the lineage,
    outlives lost executors, and keeps several consumers from computing it again. Its shuffles' files are
    deleted as soon as it is written, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave. Only for those that nothing still to be worked out reads: what was itself written no longer does."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def give_back() -> None:
    """Returns freed memory to the system, which Arrow's pool and the C library would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back after large batches and at the end of a task. Python workers serve one stage after another, several
    at a time, and each would keep the most that any of its tasks has needed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            large = batch.nbytes >= _LARGE
            yield batch
            del batch
            if large:
                give_back()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(each(batches))
        give_back()

    return whole


def with_new(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: int, new: list[T.StructField]) -> DataFrame:
    """``docs.mapInArrow(run)`` of its first ``keep`` columns and ``new`` ones, by place: Spark cannot map columns with dots in their names."""
    numbers = lambda n: [f"c{i}" for i in range(n)]
    fields = [T.StructField(c, f.dataType) for c, f in zip(numbers(keep + len(new)), [*docs.schema.fields[:keep], *new], strict=True)]
    return docs.toDF(*numbers(len(docs.columns))).mapInArrow(lean(run), T.StructType(fields)).toDF(*docs.columns[:keep], *(f.name for f in new))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, also where ``body`` uses it inside other lambdas
    (a column that is merely named there would be inlined and worked out for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
