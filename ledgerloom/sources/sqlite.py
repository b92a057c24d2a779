"""SQLite tables as Spark rows, with the write-ahead log applied when there is one."""

from __future__ import annotations

import hashlib
import os
import shutil
import sqlite3
import tempfile
from contextlib import contextmanager
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import _open_fs, dealt

#: rows of one (file, table) read by one task
SPLIT_ROWS = 200_000
BATCH_ROWS = 5_000
# Bookkeeping tables of the platform.
SKIPPED_TABLES = {"android_metadata", "room_master_table", "sqlite_sequence"}

SPLITS = (
    "case_id string, root string, path string, name string, has_log boolean, sha256 string, "
    "source_table string, lo bigint, hi bigint, n_rows bigint, error string"
)
ROWS = (
    "case_id string, source_file string, file_name string, source_table string, rowid bigint, "
    "read_mode string, sha256 string, row map<string,string>"
)


def _fetch(system, source: str, target: str) -> str:
    digest = hashlib.sha256()
    with system.open_input_stream(source) as stream, open(target, "wb") as out:
        while chunk := stream.read(1 << 20):
            digest.update(chunk)
            out.write(chunk)
    return digest.hexdigest()


def _digest(system, source: str) -> str:
    digest = hashlib.sha256()
    with system.open_input_stream(source) as stream:
        while chunk := stream.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def _connect(uri: str) -> sqlite3.Connection:
    con = sqlite3.connect(uri, uri=True)
    con.text_factory = lambda b: b.decode("utf-8", errors="replace")
    return con


@contextmanager
def _database(root: str, path: str, with_log: bool):
    """A read-only connection and how it was made.

    A local file without a log is opened in place. Otherwise the task works on its own scratch
    copy, which lives only as long as the task; the source is hashed again after copying.
    """
    system, base = _open_fs(root)
    source = f"{base}/{path}"
    local = type(system).__name__ == "LocalFileSystem"
    if local and not with_log:
        con = _connect(f"file:{quote(source)}?mode=ro&immutable=1")
        try:
            yield con, "immutable"
        finally:
            con.close()
        return
    scratch = tempfile.mkdtemp(prefix="sqlite-read-")
    con = None
    try:
        copy = os.path.join(scratch, "db")
        before = _fetch(system, source, copy)
        if with_log:
            for side in ("-wal", "-shm"):
                try:
                    _fetch(system, source + side, copy + side)
                except OSError:
                    pass
            if _digest(system, source) != before:
                raise RuntimeError(f"source changed while copying: {source}")
        con = _connect(f"file:{quote(copy)}?mode=ro" + ("" if with_log else "&immutable=1"))
        yield con, "wal_applied" if with_log else "immutable"
    finally:
        if con is not None:
            con.close()
        shutil.rmtree(scratch, ignore_errors=True)


def _quoted(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


def _tables(con) -> list[str]:
    try:
        found = con.execute("SELECT name FROM sqlite_master WHERE type='table' ORDER BY name")
        return [t for (t,) in found.fetchall() if t not in SKIPPED_TABLES]
    except sqlite3.DatabaseError:
        return []


def _table_splits(con, failed: list[tuple] | None = None) -> list[tuple]:
    """(table, lo, hi, rows) of every range to read; ``failed`` takes (table, error) of unreadable tables."""
    out, failed = [], [] if failed is None else failed
    for table in _tables(con):
        try:
            lo, hi, n = con.execute(
                f"SELECT min(rowid), max(rowid), count(*) FROM {_quoted(table)}"
            ).fetchone()
        except sqlite3.OperationalError:  # a table without rowid is read in one piece
            try:
                n = con.execute(f"SELECT count(*) FROM {_quoted(table)}").fetchone()[0]
            except sqlite3.DatabaseError as e:
                failed.append((table, str(e)))
                continue
            out.append((table, None, None, n))
            continue
        except sqlite3.DatabaseError as e:
            failed.append((table, str(e)))
            continue
        if not n:
            continue
        # sparse rowids: widen the ranges so that their number follows the rows, not the ids
        pieces = max(1, -(-n // SPLIT_ROWS))
        width = -(-(hi - lo + 1) // pieces)
        out += [(table, s, min(s + width - 1, hi), n) for s in range(lo, hi + 1, width)]
    return out


def _damage(con) -> list[str]:
    """What a check of the whole file finds first: a damaged page may give wrong rows without an error."""
    try:
        found = con.execute("PRAGMA quick_check(1)").fetchone()[0]
    except sqlite3.DatabaseError as e:
        found = str(e)
    return [] if found == "ok" else [found]


def _plan_files(batches):
    cols = [c.split()[0] for c in SPLITS.split(", ")]
    for pdf in batches:
        rows = []
        for case_id, root, path, name, has_log, sha256 in pdf.itertuples(index=False):
            failed = []
            for mode in ([True, False] if has_log else [False]):
                failed.clear()
                try:
                    with _database(root, path, mode) as (con, _):
                        con.execute("SELECT count(*) FROM sqlite_master").fetchone()
                        splits = _table_splits(con, failed)
                        failed += [(None, e) for e in _damage(con)]
                except (sqlite3.Error, OSError, RuntimeError) as e:
                    failed.append((None, str(e)))
                    continue  # an unreadable log falls back to the plain file
                if splits or not mode:
                    rows += [(case_id, root, path, name, mode, sha256, *s, None) for s in splits]
                    break
            rows += [(case_id, root, path, name, has_log, sha256, t, None, None, -1, e) for t, e in failed]
        yield pd.DataFrame(rows, columns=cols).astype({"lo": "Int64", "hi": "Int64"})


def _cell(v) -> str | None:
    if v is None:
        return None
    return v.hex() if isinstance(v, bytes) else str(v)


def database_files(inventory: DataFrame) -> DataFrame:
    """Database files with a flag for a non-empty write-ahead log next to them."""
    logs = inventory.where(F.col("name").endswith("-wal") & (F.col("size") > 0)).select(
        "case_id", F.regexp_replace("path", "-wal$", "").alias("path"), F.lit(True).alias("has_log")
    )
    dbs = inventory.where(~F.col("name").rlike("-(wal|shm|journal)$"))
    sha256 = F.col("sha256") if "sha256" in dbs.columns else F.lit(None).cast("string")
    return dbs.join(logs, ["case_id", "path"], "left").select(
        "case_id", "root", "path", "name",
        F.coalesce("has_log", F.lit(False)).alias("has_log"),
        sha256.alias("sha256"),
    )


def table_splits(databases: DataFrame) -> DataFrame:
    """What to read: (file, table, rowid range). Row counts come along for reconciliation; a file or table
    that cannot be read is a row with an ``error`` and no range."""
    spread = dealt(databases, "case_id", "path")
    return spread.select("case_id", "root", "path", "name", "has_log", "sha256").mapInPandas(
        _plan_files, SPLITS
    )


def _count_both(batches):
    cols = ["case_id", "path", "source_table", "n_before", "n_after"]
    for pdf in batches:
        rows = []
        for case_id, root, path in pdf.itertuples(index=False):
            counts = []
            for mode in (False, True):
                try:
                    with _database(root, path, mode) as (con, _):
                        counts.append(
                            {
                                t: con.execute(f"SELECT count(*) FROM {_quoted(t)}").fetchone()[0]
                                for t in _tables(con)
                            }
                        )
                except (sqlite3.Error, OSError, RuntimeError):
                    break
            if len(counts) == 2:
                before, after = counts
                for t in sorted(after):
                    if before.get(t, 0) != after[t]:
                        rows.append((case_id, path, t, before.get(t, 0), after[t]))
        yield pd.DataFrame(rows, columns=cols)


def log_deltas(databases: DataFrame) -> DataFrame:
    """Rows per table without and with the write-ahead log, where they differ."""
    change = F.col("n_after") - F.col("n_before")
    return (
        dealt(databases.where("has_log"), "case_id", "path")
        .select("case_id", "root", "path")
        .mapInPandas(
            _count_both,
            "case_id string, path string, source_table string, n_before bigint, n_after bigint",
        )
        .withColumn("net_hidden", F.greatest(change, F.lit(0)))
        .withColumn("net_deleted", F.greatest(-change, F.lit(0)))
    )


def land(rows: DataFrame, path: str) -> None:
    """Landed rows, laid out so that one source table is one folder to scan."""
    (
        rows.write.mode("overwrite")
        .option("maxRecordsPerFile", 2_000_000)
        .partitionBy("source_table")
        .parquet(path)
    )
