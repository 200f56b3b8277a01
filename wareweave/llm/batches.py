"""Helpers for tasks that receive Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text bytes that a task handles at once; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named string column stays below the limit."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def strings(column: pa.Array) -> list[str]:
    """Texts of a string column; null is empty, bytes that are no UTF-8 are replaced."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def add_columns(
    df: DataFrame, text: str, added: T.StructType, work: Callable[[list[str]], list[pa.Array]], limit: int = SLICE_BYTES
) -> DataFrame:
    """Append columns that ``work`` computes from whole texts, up to limit bytes of them at once.

    All columns of df pass through except those named like an added one.
    """
    df = df.drop(*added.names)
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                columns = work(strings(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)
