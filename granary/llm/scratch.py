"""Intermediate tables in the folder that the cluster shares, and tasks over texts in batches of bounded size."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of an Arrow batch at most, but for a single larger row; Spark's own limit is 64 MB, several times in memory at once.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a new local one in local mode; an error on a cluster, whose machines would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    df.write.parquet(path := shared_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def with_fields(fields: Iterable[StructField], more: str) -> StructType:
    """The schema of ``fields``, whatever their names and types, and then those of ``more``, such as ``fp long``."""
    return StructType([*fields, *StructType.fromDDL(more)])


def quoted(columns: Iterable[str]) -> list[str]:
    """Column names as Spark's parser takes them, whatever characters they have."""
    return [f"`{c.replace('`', '``')}`" for c in columns]


def row_hash(schema: StructType, row: str | None = None) -> Column:
    """A 64-bit hash of all columns of a table, or of the column ``row`` that holds them as a struct. Spark hashes no maps: as JSON here."""
    columns = [F.col(row).getField(f.name) if row else F.col(quoted([f.name])[0]) for f in schema]
    return F.xxhash64(*(F.to_json(F.struct(c.alias("c"))) if re.search("map<|variant", f.dataType.simpleString()) else c for c, f in zip(columns, schema)))


def place_of(columns: list[str], name: str) -> int:
    """Where a column stands, its name in any case, as Spark resolves it; an error if there is none."""
    found = [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are called {name}")
    return found[0]


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to :data:`BATCH_BYTES`. Results don't depend on it."""
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: the worker lives on beside the next tasks'."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of bounded size; memory is given back when a task ends."""
    bound_batches(df.sparkSession)
    names = df.columns

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.rename_columns(names) for b in batches)
        finally:
            release_memory()

    # PySpark looks the columns up by name here, and would take a dot in one for a field's.
    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(freed, schema)
