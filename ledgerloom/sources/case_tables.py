"""``case_tables``: SQLite tables of many cases as a Spark data source.

``spark.read.format("case_tables").option("splits", folder)`` reads what a splits table (``sqlite.table_splits``, saved as
Parquet) lists: one partition for a run of (file, table, rowid range) rows. The driver only reads the footers of that
table. A task opens, or copies, each file once for all its ranges. Conditions on case, file, table and
rowid are answered while reading: ranges outside are never opened and rowid bounds go into SQLite's own search.

The schema decides what is read. ``ROWS`` (the default) has each row as a map of texts. Any column besides those of
``ROWS`` is a column of the table with its own type (string, bigint, double, boolean, binary), and without ``row`` only
these columns are fetched; a column that a table lacks is null, and a value that does not fit its type too.

A range that cannot be read to its end gives the rows before and behind the damage, and one row with ``error``.
"""

from __future__ import annotations

import itertools
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from .files import _open_fs
from .sqlite import BATCH_ROWS, ROWS, _cell, _database, _quoted

FIXED = tuple(c.split()[0] for c in ROWS.split(", "))
#: ranges that one task reads at least, and tasks that a scan has at most
TASK_RANGES, MOST_TASKS = 16, 20_000
#: column of the output -> column of the splits table
_NAMES = {"case_id": "case_id", "source_file": "path", "file_name": "name", "source_table": "source_table"}


@dataclass
class Ranges(ds.InputPartition):
    """Rows ``first`` to ``first + n`` of one part file of the splits table."""

    def __init__(self, file: str, first: int, n: int):
        self.file, self.first, self.n = file, first, n


def _whole(v) -> int | None:
    return v if isinstance(v, int) and -(1 << 63) <= v < 1 << 63 else None


def _number(v) -> float | None:
    return float(v) if isinstance(v, int | float) else None


_TYPED = {
    T.StringType: (pa.string(), _cell),
    T.LongType: (pa.int64(), _whole),
    T.IntegerType: (pa.int32(), lambda v: v if isinstance(v, int) and -(1 << 31) <= v < 1 << 31 else None),
    T.DoubleType: (pa.float64(), _number),
    T.BooleanType: (pa.bool_(), lambda v: bool(v) if isinstance(v, int) else None),
    T.BinaryType: (pa.binary(), lambda v: v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else None),
    T.MapType: (pa.map_(pa.string(), pa.string()), lambda v: v),
}


class CaseTablesReader(ds.DataSourceReader):
    def __init__(self, splits: str, schema: T.StructType):
        self.splits, self.schema = splits, schema
        unknown = [f.name for f in schema.fields if type(f.dataType) not in _TYPED]
        if unknown:
            raise ValueError(f"columns of a type that tables do not have: {unknown}")
        self.own = [f.name for f in schema.fields if f.name not in (*FIXED, "error")]
        self.equal: dict[str, set] = {}
        self.low, self.high = None, None  # bounds of rowid, both included

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Take equality on case, file and table and bounds on rowid; give back the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value) if isinstance(f, ds.In) else None
            if column in _NAMES and values is not None:
                self.equal[column] = self.equal.get(column, values) & values
            elif column == "rowid" and isinstance(f, ds.EqualTo):
                self._bound(f.value, f.value)
            elif column == "rowid" and isinstance(f, ds.GreaterThan | ds.GreaterThanOrEqual):
                self._bound(f.value + isinstance(f, ds.GreaterThan), None)
            elif column == "rowid" and isinstance(f, ds.LessThan | ds.LessThanOrEqual):
                self._bound(None, f.value - isinstance(f, ds.LessThan))
            else:
                yield f

    def _bound(self, low: int | None, high: int | None) -> None:
        self.low = max((x for x in (self.low, low) if x is not None), default=None)
        self.high = min((x for x in (self.high, high) if x is not None), default=None)

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs as pafs
        from pyarrow import parquet

        system, base = _open_fs(self.splits)
        files = [i.path for i in system.get_file_info(pafs.FileSelector(base)) if i.path.endswith(".parquet")]
        sizes = [(f, parquet.read_metadata(f, filesystem=system).num_rows) for f in sorted(files)]
        step = max(TASK_RANGES, -(-sum(n for _, n in sizes) // MOST_TASKS))
        return [Ranges(f, at, min(step, n - at)) for f, n in sizes for at in range(0, n, step)]

    def _wanted(self, partition: Ranges) -> list[dict]:
        from pyarrow import parquet

        system, _ = _open_fs(self.splits)
        rows = parquet.read_table(partition.file, filesystem=system).slice(partition.first, partition.n).to_pylist()
        for column, values in self.equal.items():
            rows = [r for r in rows if r[_NAMES[column]] in values]
        kept = []
        for r in rows:
            if self.low is not None or self.high is not None:
                if r["lo"] is None or (self.low is not None and r["hi"] < self.low) or (self.high is not None and r["lo"] > self.high):
                    continue  # rows without a rowid meet no bound
                r["lo"], r["hi"] = max(r["lo"], self.low or r["lo"]) if self.low is not None else r["lo"], min(r["hi"], self.high) if self.high is not None else r["hi"]
            if r["error"] is None:
                kept.append(r)
        return kept

    def _select(self, con, table: str, lo, hi, order: str = "") -> tuple[list[str], Iterator[tuple]]:
        """(names of the columns fetched, rows with the rowid first)."""
        have = {r[1].lower(): r[1] for r in con.execute(f"PRAGMA table_info({_quoted(table)})")}
        if any(f.name == "row" for f in self.schema.fields):
            names = list(have.values())
        else:
            names = [have[c.lower()] for c in self.own if c.lower() in have]
        columns = ", ".join(["NULL" if lo is None else "rowid", *map(_quoted, names)])
        where, bounds = ("", ()) if lo is None else (f" WHERE rowid BETWEEN ? AND ? ORDER BY rowid{order}", (lo, hi))
        return names, con.execute(f"SELECT {columns} FROM {_quoted(table)}{where}", bounds)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a splits table without rows
            return
        same_file = lambda r: (r["root"], r["path"], r["has_log"])
        for (root, path, has_log), splits in itertools.groupby(sorted(self._wanted(partition), key=lambda r: (*same_file(r), r["source_table"], r["lo"] or 0)), same_file):
            splits = list(splits)
            done = 0
            try:
                with _database(root, path, has_log) as (con, mode):
                    for s in splits:
                        yield from self._rows(con, mode, s)
                        done += 1
            except (sqlite3.Error, OSError, RuntimeError) as e:  # the file itself cannot be opened
                yield self._batch([(s, None, [], (), None, str(e)) for s in splits[done:]])

    def _rows(self, con, mode: str, split: dict) -> Iterator[pa.RecordBatch]:
        table, lo, hi = split["source_table"], split["lo"], split["hi"]
        rows, error, last = [], None, None
        for order in ("", " DESC"):
            try:
                names, found = self._select(con, table, lo, hi, order)
                for rowid, *values in found:
                    if not order:
                        last = rowid
                    rows.append((split, rowid, names, values, mode, None))
                    if len(rows) >= BATCH_ROWS:
                        yield self._batch(rows)
                        rows = []
                break
            except sqlite3.Error as e:
                error = error or str(e)
            if lo is None:
                break
            lo = lo if last is None else last + 1  # from the range's end back to the damage
        if error:
            rows.append((split, None, [], (), mode, error))
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = []
        place = {id(names): {n.lower(): i for i, n in enumerate(names)} for _, _, names, _, _, _ in rows}
        for f in self.schema.fields:
            kind, as_kind = _TYPED[type(f.dataType)]
            if f.name in _NAMES:
                values = [s[_NAMES[f.name]] for s, *_ in rows]
            elif f.name == "sha256":
                values = [s["sha256"] for s, *_ in rows]
            elif f.name in ("rowid", "read_mode", "error"):
                values = [r[{"rowid": 1, "read_mode": 4, "error": 5}[f.name]] for r in rows]
            elif f.name == "row":
                values = [None if r[5] else [(n, _cell(v)) for n, v in zip(r[2], r[3], strict=True)] for r in rows]
            else:
                at = f.name.lower()
                values = [as_kind(r[3][i]) if (i := place[id(r[2])].get(at)) is not None and r[3][i] is not None else None for r in rows]
            columns.append(pa.array(values, kind))
        return pa.RecordBatch.from_arrays(columns, names=self.schema.fieldNames())


class CaseTables(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "case_tables"

    def schema(self) -> str:
        return f"{ROWS}, error string"

    def reader(self, schema: T.StructType) -> CaseTablesReader:
        return CaseTablesReader(self.options["splits"], schema)


def case_tables(spark: SparkSession, splits: str, ddl: str | None = None) -> DataFrame:
    """Rows that the splits table at ``splits`` lists, as ``ddl`` wants them (default: ``ROWS`` and ``error``)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaseTables)
    reader = spark.read.format(CaseTables.name()).option("splits", splits)
    return (reader.schema(ddl) if ddl else reader).load()
