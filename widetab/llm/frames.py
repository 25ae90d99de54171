"""What the operators share: the columns they read, stored intermediates, and numpy columns back into Spark."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widetab.session import cut_lineage, scratch

__all__ = ["batch", "cut_lineage", "documents", "read", "release", "restore", "schema_of", "scratch"]


def read(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns are neither read nor able to clash with names used inside."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()),
}


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a simple Spark DDL string."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def restore(like: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``like`` in its order and types."""
    return changed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema])


def release(spark) -> None:
    """Let Spark delete the shuffle files and checkpoints that no frame refers to any more.

    It does so after a garbage collection of the driver's JVM, which a driver with little to do may put off for many
    rounds of an iteration.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
