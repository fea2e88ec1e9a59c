"""Python over rows of texts in Arrow, a slice of each batch at a time: a worker never holds a whole batch as objects."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of Arrow data that are worked on at once; a larger row is a slice of its own.
SLICE = 1 << 19


def slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in order, halved until a part has limit bytes at most or one row."""
    if batch.nbytes <= limit or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), limit)
        yield from slices(batch.slice(half), limit)


def _give_back() -> None:
    """A worker stays alive beside later stages; it gives memory back that it no longer needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, work: Callable[[list[dict]], list[dict]], shape: str) -> DataFrame:
    """work(rows) for the rows of each slice; shape: the columns of its rows, where a map is a list of pairs."""
    schema = to_arrow_schema(StructType.fromDDL(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pylist(work(part.to_pylist()), schema)
        _give_back()

    return df.mapInArrow(run, shape)
