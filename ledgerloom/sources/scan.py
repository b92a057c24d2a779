"""Scans of binary files that never hold a whole file: blocks, open runs carried over their borders, true offsets.

A scan is a generator ``scan(read, size, start, end)`` over one segment of a file, where ``read(at, n)`` gives bytes. It owns what
begins in the segment: it passes over a run that began before ``start`` and reads on behind ``end`` until the run it is
in closes, as line readers do at split borders. So the segments of a large file are scanned by several tasks and the
rows are those of one pass over the file. Bytes that are already in a column are scanned the same way, as one segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .files import _open_fs, dealt

SEGMENT = 64 << 20  #: bytes of a file that one task scans
BLOCK = 1 << 20  #: bytes read at a time
ROWS = 4096  #: rows of an output batch

Read = Callable[[int, int], bytes]
Scan = Callable[[Read, int, int, int], Iterator[tuple]]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def _out(files: DataFrame, keys: list[str], ddl: str) -> T.StructType:
    return T.StructType([*files.select(*keys).schema.fields, *T.StructType.fromDDL(ddl).fields])


def scan_files(files: DataFrame, keys: list[str], ddl: str, scan: Scan, whole: bool = False) -> DataFrame:
    """(keys, columns of ``ddl``) of every row that ``scan`` gives for the files (case_id, root, path, size, ...).

    Files above ``SEGMENT`` bytes are scanned by several tasks, unless the scan needs one pass (``whole``): then one task
    reads the file, block by block. A file that cannot be read gives no rows; the manifest logs it.
    """
    schema = _out(files, keys, ddl)
    shape = to_arrow_schema(schema)
    step = F.col("size") if whole else F.lit(SEGMENT)
    parts = files.where("size > 0").select(
        *[F.col(k).alias(f"_{k}") for k in keys], "root", "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, step)).alias("start")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for part in batch.to_pylist():
                    own = tuple(part[f"_{k}"] for k in keys)
                    try:
                        system, base = _open_fs(part["root"])
                        with system.open_input_file(f"{base}/{part['path']}") as file:
                            end = part["size"] if whole else min(part["start"] + SEGMENT, part["size"])
                            for found in scan(lambda at, n: file.read_at(n, at), part["size"], part["start"], end):
                                yield *own, *found
                    except OSError:
                        continue

        yield from _batches(rows(), shape)

    return dealt(parts, "root", "path", "start").mapInArrow(run, schema)


def scan_cells(cells: DataFrame, keys: list[str], ddl: str, scan: Scan, content: str = "content") -> DataFrame:
    """:func:`scan_files` over bytes in a column; a null has no rows."""
    schema = _out(cells, keys, ddl)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for *own, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if body:
                        for found in scan(lambda at, n, body=body: body[at : at + n], len(body), 0, len(body)):
                            yield *own, *found

        yield from _batches(rows(), shape)

    return cells.select(*keys, F.col(content).cast("binary")).mapInArrow(run, schema)


# ---- runs ------------------------------------------------------------------------------------


def alphabet(pattern: str) -> np.ndarray:
    """A table of the bytes that a character class holds."""
    return np.array([re.fullmatch(pattern.encode(), bytes([b])) is not None for b in range(256)])


PRINTABLE = alphabet(r"[\x20-\x7e]")


def runs(read: Read, size: int, start: int, end: int, inside: np.ndarray, shortest: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the maximal runs of ``inside`` bytes, ``shortest`` or longer, that begin in [start, end)."""
    at, open_at, parts = start, None, []
    passing = start > 0 and bool(inside[read(start - 1, 1)[0]])
    while at < size and (at < end or open_at is not None):
        block = read(at, min(BLOCK, size - at))
        edges = np.diff(inside[np.frombuffer(block, np.uint8)].astype(np.int8), prepend=0, append=0)
        firsts, lasts = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        goes_on = len(firsts) > 0 and firsts[0] == 0
        if passing or open_at is not None:
            if goes_on and lasts[0] == len(block) and at + len(block) < size:
                parts += [block] if open_at is not None else []
                at += len(block)
                continue
            if open_at is not None:
                whole = b"".join([*parts, block[: lasts[0]] if goes_on else b""])
                if len(whole) >= shortest:
                    yield open_at, whole
            firsts, lasts = firsts[int(goes_on) :], lasts[int(goes_on) :]
            passing, open_at, parts = False, None, []
        if len(lasts) and lasts[-1] == len(block) and at + len(block) < size and at + firsts[-1] < end:
            open_at, parts = at + int(firsts[-1]), [block[firsts[-1] :]]
            firsts, lasts = firsts[:-1], lasts[:-1]
        kept = np.flatnonzero((lasts - firsts >= shortest) & (at + firsts < end))
        for a, b in zip(firsts[kept].tolist(), lasts[kept].tolist(), strict=True):
            yield at + a, block[a:b]
        at += len(block)
    if open_at is not None:
        whole = b"".join(parts)
        if len(whole) >= shortest:
            yield open_at, whole


def printable(shortest: int) -> Scan:
    """(offset, value): runs of printable ASCII, whole."""
    def scan(read, size, start, end):
        for at, value in runs(read, size, start, end, PRINTABLE, shortest):
            yield at, value.decode("ascii")

    return scan


# ---- storage entries -------------------------------------------------------------------------

# Layout of browser local storage inside its log-structured files, and how far behind its key
# a value begins at most.
_ENTRY = re.compile(rb"_(https?://[\x21-\x7e]{3,})\x00\x01?([\x20-\x7e]+)")
_VALUE = re.compile(rb"[\x20-\x7e]{4,}")
REACH = 220
_VISIBLE, _SHOWN = bytes(range(0x21, 0x7F)), bytes(range(0x20, 0x7F))


def _undecided(buffer: bytes, at: int) -> int:
    """Where, from ``at`` on, an entry that goes on behind the buffer may begin."""
    head = buffer.rstrip(_SHOWN)
    for mark in (b"\x00\x01", b"\x00", b""):
        if head.endswith(mark):
            head = head[: len(head) - len(mark)].rstrip(_VISIBLE) if mark else buffer.rstrip(_VISIBLE)
            break
    first = buffer.find(b"_http", max(at, len(head)))
    return first if first >= 0 else max(at, len(head), len(buffer) - 5)


def storage_entries(read: Read, size: int, start: int, end: int) -> Iterator[tuple[int, str, str, str | None]]:
    """(offset, origin, key, value) of a storage file, in one pass.

    An entry is an underscore, the origin up to a NUL, and a key of printable bytes. Its value is the first printable
    run of four bytes or more that begins within ``REACH`` bytes behind the key, and ends where it ends or where
    the next entry begins. Origins, keys and values come whole, whatever their length. The file is read in
    blocks, of which only an entry that is not closed yet is kept.
    """
    buffer, base, at, read_to = b"", 0, 0, 0
    while True:
        ended = read_to >= size
        found, value = _ENTRY.search(buffer, at), None
        if found is not None:
            value = _VALUE.search(buffer, found.end())
            if value is not None and value.start() >= found.end() + REACH:
                value = None
            # seen are the key's end, all places where a value may begin, the value's end and an entry that begins in it
            if ended or max(found.end() + REACH + 4, value.end() + 3 if value else 0) <= len(buffer):
                text = None
                if value is not None:
                    following = _ENTRY.search(buffer, value.start())
                    stop = min(value.end(), following.start()) if following else value.end()
                    text = buffer[value.start() : stop].decode("ascii") if stop - value.start() >= 4 else None
                yield base + found.start(), found[1].decode("ascii"), found[2].decode("ascii"), text
                at = found.end()
                continue
        if ended:
            return
        cut = found.start() if found is not None else _undecided(buffer, at)
        buffer, base, at = buffer[cut:], base + cut, max(at - cut, 0)
        block = read(read_to, min(BLOCK, size - read_to))
        if not block:
            return
        buffer += block
        read_to += len(block)
