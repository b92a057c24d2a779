"""Line dedup: hashes sorted by range, first occurrences streamed, decisions kept as bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, arrow_schema, cut_lineage, drop_written, written

LAST = (1 << 63) - 1  # stands for a null document id: it comes after every other
LINES = "h1 bigint, h2 bigint, doc bigint, row bigint, line int"
FOUND = "part int, h1 bigint, h2 bigint, doc bigint, row bigint, line int, first bigint, kind string"


def _long_enough(key: bytes, least: int) -> bool:
    """At least ``least`` code points; only short keys are decoded."""
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode()) >= least)


def hashed_lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(h1, h2, doc, row, line) of every line whose key is long enough; h1 and h2 are one 128-bit hash."""
    shape = arrow_schema(LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs_, rows, lines = [], [], [], []
            for doc, row, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, line in enumerate((body or "").encode().split(b"\n")):
                    line = line.strip(SPACE).lower()
                    if _long_enough(line, least):
                        digests.append(xxhash.xxh3_128_digest(line))
                        docs_.append(doc)
                        rows.append(row)
                        lines.append(at)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(docs_, pa.int64()),
                 pa.array(rows, pa.int64()), pa.array(lines, pa.int32())], schema=shape,
            )

    doc = F.coalesce(F.col(key), F.lit(LAST)).alias("doc")
    return docs.select(doc, F.xxhash64(text).alias("row"), text).mapInArrow(run, LINES)


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a sorted partition: emit the lines after the first document of their run.

    A run that begins with the partition may go on from the one before: its lines are emitted as
    ``open``. The last row tells the next partition where this one's last run began.
    """
    shape = arrow_schema(FOUND)
    part = TaskContext.get().partitionId()
    opening = last = None  # key of the first run; key and first document of the running one
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, row, line = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        fresh = np.ones(len(h1), dtype=bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = last is not None and last[0] == h1[0] and last[1] == h2[0]
        fresh[0] = not goes_on
        starts = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), -1))
        first = np.where(starts >= 0, doc[np.maximum(starts, 0)], last[2] if goes_on else 0)
        if opening is None:
            opening = (h1[0], h2[0])
        is_open = (h1 == opening[0]) & (h2 == opening[1])
        last = (h1[-1], h2[-1], first[-1])
        out = np.flatnonzero(is_open | (doc != first))
        kind = np.where(is_open[out], "open", "drop")
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(out), part, dtype=np.int32)), *(pa.array(x[out]) for x in (h1, h2, doc, row, line, first)),
             pa.array(kind, pa.string())], schema=shape,
        )
    if last is not None:
        for (a, b), first, kind in ((opening, None, "opens"), (last[:2], last[2], "ends")):
            values = [part, a, b, None, None, None, first, kind]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape, strict=True)], schema=shape)


def dropped_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10
) -> tuple[DataFrame, list[str]]:
    """(doc, row, line) of every line that goes, and the scratch tables that this reads.

    The lines are sorted by range of (hash, document, line), so a line that a third of all documents
    hold is spread over as many partitions as it needs. What a partition must know of the ones before
    it is one row per partition.
    """
    lines, hashed = written(hashed_lines(docs, key, text, least), "lines")
    order = ["h1", "h2", "doc", "row", "line"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found, runs = written(ordered.mapInArrow(_first_occurrences, FOUND), "lineruns")
    edges: dict[int, dict[str, tuple]] = {}
    for r in found.where("kind IN ('opens', 'ends')").orderBy("part").toLocalIterator():
        edges.setdefault(r.part, {})[r.kind] = ((r.h1, r.h2), r.first)
    carried, run = [], (None, None)  # the run that reaches the partition's start: key, first document
    for part in sorted(edges):
        opens, ends = edges[part]["opens"][0], edges[part]["ends"]
        goes_on = run[0] == opens
        if goes_on:
            carried.append((part, run[1]))
        run = run if goes_on and ends[0] == opens else ends
    starts = docs.sparkSession.createDataFrame(carried, "part int, carried bigint")
    rows = found.where("kind IN ('open', 'drop')").join(F.broadcast(starts), "part", "left")
    first = F.when(F.col("kind") == "open", F.coalesce("carried", "first")).otherwise(F.col("first"))
    return rows.where(F.col("doc") != first).select("doc", "row", "line"), [hashed, runs]


@F.pandas_udf(T.BinaryType())
def _packed(n: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n: int, gone) -> bytes:
        bits = np.ones(n, dtype=bool)
        bits[np.asarray(gone, dtype=np.int64)] = False
        return zlib.compress(np.packbits(bits).tobytes())

    return pd.Series([None if d is None else one(k, d) for k, d in zip(n, dropped, strict=True)])


@F.pandas_udf(T.StringType())
def _kept(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    def one(body: str, packed: bytes) -> str:
        lines = body.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), count=len(lines))
        return "\n".join(line for line, keep in zip(lines, bits, strict=True) if keep)

    return pd.Series([t if b is None else one(t, b) for t, b in zip(texts, bitmaps, strict=True)])


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(doc, row, n_lines, n_dropped, keep) of each document that loses lines.

    ``keep`` is a zlib-packed bitmap with one bit per line; documents without a row here keep all.
    ``doc`` is the id (null ids are one document after all others, LAST) and ``row`` the xxhash64 of
    the text, so rows that share an id keep bitmaps of their own.
    """
    dropped, scratch = dropped_lines(docs, key, text, least)
    gone = dropped.groupBy("doc", "row").agg(F.collect_set("line").alias("gone"))
    sizes = docs.select(
        F.coalesce(F.col(key), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), _n_lines(text).alias("n_lines")
    ).groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines"))
    both = sizes.join(gone, ["doc", "row"])
    maps = both.select("doc", "row", "n_lines", F.size("gone").alias("n_dropped"), _packed("n_lines", "gone").alias("keep"))
    maps = cut_lineage(maps)
    for path in scratch:
        drop_written(docs.sparkSession, path)
    return maps


def _n_lines(text: str):
    body = F.coalesce(F.col(text), F.lit(""))
    return (F.length(body) - F.length(F.replace(body, F.lit("\n"))) + 1).cast("bigint")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """``docs`` with lines that an earlier document holds taken out, plus n_lines and n_dropped.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of ``least`` code
    points or more that two documents hold stay in the document of the smallest id only, all its
    occurrences included. A null text counts as empty: one line, nothing dropped, result ``''``. Rows
    of one id are one document; null ids are one document, the last. An empty table stays empty.
    Other columns pass unchanged; input columns called n_lines, n_dropped, _keep, _dropped, _doc or _row are not passed on.
    """
    maps = keep_bitmaps(docs, key, text, least).select(
        F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("n_dropped").alias("_dropped"), F.col("keep").alias("_keep")
    )
    kept = [c for c in docs.columns if c not in {"n_lines", "n_dropped", "_keep", "_dropped", "_doc", "_row"}]
    keyed = docs.select(*kept, F.coalesce(F.col(key), F.lit(LAST)).alias("_doc"), F.xxhash64(text).alias("_row"))
    joined = keyed.join(maps, ["_doc", "_row"], "left")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return joined.select(
        *[_kept(body, "_keep").alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        _n_lines(text).alias("n_lines"),
        F.coalesce(F.col("_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
