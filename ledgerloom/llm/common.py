"""Helpers of the training-data operators: written tables and word hashes."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _ensure_checkpoint_dir, cut_lineage, tune

__all__ = ["cut_lineage", "tune", "written", "drop_written", "release", "table", "arrow_schema", "crc_of_id", "word_hashes", "mix64", "merge", "SPACE"]

#: the six white-space bytes the operators split at; ``bytes.split()`` uses exactly these
SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir`` and read it back.

    Lineage ends here, so a lost executor costs no more than the tasks it held.
    """
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    """Remove a table of :func:`written` that nothing reads any more."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of steps whose results are written and whose plans are
    out of scope; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "smallint": pa.int16(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
}
_ARROW |= {f"array<{k}>": pa.list_(v) for k, v in _ARROW.items()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a flat DDL schema; works on executors too."""
    fields = (field.strip().rsplit(" ", 1) for field in ddl.split(", "))
    return pa.schema([(name.strip("`"), _ARROW[kind]) for name, kind in fields])


def crc_of_id(column: str | Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    key = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SIZE = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_SIZE, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        filled = 1
        step = np.uint64(base)
        while filled < _SIZE:
            out[filled : 2 * filled] = out[:filled] * step
            step = step * step
            filled *= 2
    return out


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _tile(powers: np.ndarray, base: int, n: int) -> np.ndarray:
    """powers[0:n] for any n: blocks of the table times the power that each block starts with."""
    if n <= _SIZE:
        return powers[:n]
    starts = np.array([pow(base, k * _SIZE, 1 << 64) for k in range(-(-n // _SIZE))], dtype=np.uint64)
    return (starts[:, None] * powers[None, :]).reshape(-1)[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a byte string, in order, without a Python step per word.

    A word's hash is a polynomial over its bytes, taken from one running sum over the text and
    shifted back to the word's start, then scrambled with the word's length.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    steps = np.diff(inside)
    first, last = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if not len(first):
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _tile(_UP, _BASE, len(raw)), out=total[1:])
        value = (total[last] - total[first]) * _tile(_DOWN, _INVERSE, len(raw))[first]
        return mix64(value + (last - first).astype(np.uint64) * _ODD)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; a label is the smallest index of its class."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
