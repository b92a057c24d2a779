"""Vectors as the embedding operators take them: checked, one row per different vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector that is not null, not empty, not all zero
    and has only finite components."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    kind = table.schema[vector].dataType.elementType
    narrow = isinstance(kind, (T.FloatType, T.ByteType, T.ShortType))
    v = v.cast(f"array<{'float' if narrow else 'double'}>")
    return table.where(F.col(key).isNotNull() & v.isNotNull() & fine & some).select(
        F.col(key).cast("bigint").alias("id"), v.alias("v")
    )


def classes(rows: DataFrame) -> DataFrame:
    """(node, copies, v): equal vectors are one row, named by their smallest id. Sums combine inside
    tasks, so a vector that a third of the rows hold sends few."""
    return rows.groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def by_group(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cut a stream sorted by its first column into pieces of whole groups. Of a group of more than twice
    ``most`` rows the next whole multiple of ``most`` may come first, and at least ``most`` rows later; the caller
    cuts groups of more than ``most`` rows into parts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))
        while len(key) - cut >= 2 * most:
            cut += most
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
