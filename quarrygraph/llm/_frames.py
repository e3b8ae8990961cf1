"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_bytes(text: str = "text") -> Column:
    """Length of a text in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a whole text column: one number for the driver."""
    return df.agg(F.coalesce(F.sum(text_bytes(text)), F.lit(0)).alias("n")).first()["n"]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that keep Python objects few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_held: dict[Hashable, Any] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hold(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one large object that a worker process keeps from task to task; another key takes its place."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what an earlier operator left in this worker process and give freed memory back to the system."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def to_batch(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)
