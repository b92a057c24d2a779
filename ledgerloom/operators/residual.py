"""Identifiers left in binary content that no live record carries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parties import identifier_kind
from ..sources.scan import BLOCK, alphabet, runs, scan_files
from .skew import anti_known

# Shapes searched in raw content, by identifier kind.
RESIDUAL_SHAPES = {
    "vpa": r"[a-zA-Z0-9._-]{2,40}@[a-zA-Z]{3,15}",
    "rrn": r"(?<![0-9])[0-9]{12}(?![0-9])",
    "phone": r"(?<![0-9])[6-9][0-9]{9}(?![0-9])",
    "txn_id": r"(?:PYTM|PTM|AXI|HDF|UPI|ICI|SBI)[A-Za-z0-9]{8,40}",
}
CONFIDENCE = 0.5


#: every shape lies inside a run of these bytes
_TOKEN = alphabet("[A-Za-z0-9._@-]")
_SHORTEST = 6
FOUND = "kind string, value string, byte_offset bigint"


def _matches(pieces: list, starts: np.ndarray, joined) -> Iterator[tuple[int, str, str, int]]:
    """(piece, kind, value, place in the piece) of every shape in pieces joined by line ends."""
    shapes = {k: re.compile(s if isinstance(joined, str) else s.encode()) for k, s in RESIDUAL_SHAPES.items()}
    for kind, shape in shapes.items():
        found = [(m.start(), m.group()) for m in shape.finditer(joined)]
        at = np.array([f[0] for f in found], dtype=np.int64)
        piece = np.searchsorted(starts, at, side="right") - 1
        for k, place, (_, value) in zip(piece.tolist(), (at - starts[piece]).tolist(), found, strict=True):
            yield k, kind, value if isinstance(value, str) else value.decode("ascii"), place


def identifiers(read, size: int, start: int, end: int) -> Iterator[tuple[str, str, int]]:
    """(kind, value, offset): the identifiers of a file segment, looked for in its runs of identifier bytes."""
    def solved(held: list[tuple[int, bytes]]):
        lengths = np.array([len(r) + 1 for _, r in held])
        for k, kind, value, place in _matches(held, np.cumsum(lengths) - lengths, b"\n".join(r for _, r in held)):
            yield kind, value, held[k][0] + place

    held, room = [], BLOCK
    for run in runs(read, size, start, end, _TOKEN, _SHORTEST):
        held.append(run)
        room -= len(run[1])
        if room < 0:
            yield from solved(held)
            held, room = [], BLOCK
    if held:
        yield from solved(held)


def _valid_firsts(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first place of each valid value of a blob."""
    valid = found.where(identifier_kind("value") == F.col("kind"))
    return valid.groupBy(*keys, "kind", "value").agg(F.min("byte_offset").alias("byte_offset"))


def harvest(content: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, value, byte_offset) of every valid identifier in the text of each row.

    ``text`` must be a one-character-per-byte decoding, so the offset is a byte offset. The same
    value in one row is reported once, at its first match (not inside a longer run of digits). The texts
    of a batch are searched together.
    """
    ids = content.select(*keys).schema.fields
    schema = T.StructType([*ids, *T.StructType.fromDDL(FOUND).fields])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
            first: dict[tuple, int] = {}
            for k, kind, value, place in _matches(texts, np.cumsum(lengths) - lengths, "\n".join(texts)):
                first.setdefault((k, kind, value), place)
            hits = [*zip(*first, strict=True)] if first else [[], [], []]
            rows = pa.array(hits[0], pa.int64())
            known = [batch.column(c).take(rows) for c in range(len(keys))]
            found = [pa.array(hits[1], pa.string()), pa.array(hits[2], pa.string()), pa.array(list(first.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*known, *found], names=schema.fieldNames())

    found = content.select(*keys, text).mapInArrow(run, schema)
    return found.where(identifier_kind("value") == F.col("kind"))


def harvest_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`harvest` over files (case_id, root, path, size, ...) of any size, read in blocks by several tasks."""
    return _valid_firsts(scan_files(files, keys, FOUND, identifiers), keys)


def live_identifiers(domains: dict[str, DataFrame]) -> DataFrame:
    """(case_id, kind, value) that the record tables already hold."""
    fields = {
        "vpa": ("counterparty_vpa", "vpas"),
        "rrn": ("rrn",),
        "txn_id": ("source_txn_id", "txn_id"),
        "phone": ("counterparty_mobile", "phone", "phones"),
    }
    parts = []
    for domain in ("transaction", "message", "person", "entity"):
        df = domains.get(domain)
        if df is None:
            continue
        for kind, columns in fields.items():
            for c in columns:
                if c in df.columns:
                    value = F.explode(c) if c in ("vpas", "phones") else F.col(c)
                    parts.append(df.select("case_id", F.lit(kind).alias("kind"), value.alias("value")))
    return reduce(DataFrame.unionByName, parts).where("value <> ''").distinct()


def residual_identifiers(found: DataFrame, live: DataFrame) -> DataFrame:
    """Of the identifiers found in content those that are not live, once per blob and value."""
    fresh = anti_known(found, live, {"kind": "kind", "value": "value"}, ("case_id",))
    return fresh.withColumn("confidence", F.lit(CONFIDENCE))
