"""What a normaliser reads and how it is registered."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...schemas import conform, provenance
from ...sources.files import contents, settings
from ...sources.scan import Scan, scan_cells, scan_files

#: columns that describe the source row next to its fields
SOURCE = ("case_id", "source_file", "source_table", "rowid", "sha256", "read_mode", "raw")


#: columns of a file that a scan passes on
FILE = ("case_id", "path", "name", "size", "sha256")


class Sources:
    """Source rows by (file, table). A missing table gives no rows and a missing column gives nulls,
    so a changed app version never stops a run."""

    def rows(self, file_pattern: str, table: str, *columns: str) -> DataFrame:
        raise NotImplementedError

    def any_table(self, file_pattern: str, table_pattern: str) -> DataFrame:
        """Rows of all matching tables with their fields in a map column ``row``."""
        raise NotImplementedError

    def files(self, path_pattern: str) -> DataFrame:
        """(case_id, path, name, size, content, sha256) of matching files."""
        raise NotImplementedError

    def scan(self, path_pattern: str, ddl: str, scan: Scan, whole: bool = False) -> DataFrame:
        """(case_id, path, name, size, sha256, columns of ``ddl``) that a block-wise scan finds in matching files."""
        raise NotImplementedError

    def settings(self, path_pattern: str) -> DataFrame:
        """(case_id, path, name, sha256, key, value) of key/value XML files."""
        raise NotImplementedError


class LandedSources(Sources):
    """Sources over landed rows (see ``sources.sqlite.ROWS``) and a file inventory."""

    def __init__(
        self, rows: DataFrame, inventory: DataFrame, bank_defaults: DataFrame | None = None
    ):
        self._rows, self._inventory, self.bank_defaults = rows, inventory, bank_defaults

    def _source(self, rows: DataFrame) -> list[Column]:
        return [*[F.col(c) for c in SOURCE[:-1]], F.to_json("row").alias("raw")]

    def rows(self, file_pattern, table, *columns):
        hit = (F.lower("source_table") == table.lower()) & F.col("file_name").rlike(file_pattern)
        found = self._rows.where(hit)
        fields = [F.col("row")[c].alias(c) for c in columns]
        return found.select(*self._source(found), *fields)

    def any_table(self, file_pattern, table_pattern):
        hit = F.col("file_name").rlike(file_pattern) & F.col("source_table").rlike(table_pattern)
        found = self._rows.where(hit)
        return found.select(*self._source(found), "row")

    def files(self, path_pattern):
        return contents(self._inventory.where(F.col("path").rlike(path_pattern)))

    def scan(self, path_pattern, ddl, scan, whole=False):
        return scan_files(self._inventory.where(F.col("path").rlike(path_pattern)), list(FILE), ddl, scan, whole)

    def settings(self, path_pattern):
        return settings(self.files(path_pattern), ["case_id", "path", "name", "sha256"])


class FrameSources(Sources):
    """Sources over ready-made tables: name -> DataFrame with source-shaped columns."""

    def __init__(
        self,
        spark: SparkSession,
        tables: dict[str, DataFrame],
        files: DataFrame | None = None,
        bank_defaults: DataFrame | None = None,
    ):
        self._spark, self._tables, self._files = spark, tables, files
        self.bank_defaults = bank_defaults

    def rows(self, file_pattern, table, *columns):
        df = self._tables.get(table)
        if df is None:
            empty = ", ".join(f"`{c}` string" for c in dict.fromkeys((*SOURCE, *columns)))
            return self._spark.createDataFrame([], empty)
        have = set(df.columns)
        given = [c for c in df.columns if c not in SOURCE]
        described = {
            "case_id": F.lit("case"),
            "source_file": F.lit(table),
            "source_table": F.lit(table),
            "raw": F.to_json(F.struct(*given)),
        }
        source = [
            (F.col(c) if c in have else described.get(c, F.lit(None).cast("string"))).alias(c)
            for c in SOURCE
        ]
        fields = [
            (F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns
        ]
        return df.select(*source, *fields)

    def any_table(self, file_pattern, table_pattern):
        parts = []
        for name, df in sorted(self._tables.items()):
            if re.search(table_pattern, name):
                fields = [c for c in df.columns if c not in SOURCE]
                pairs = [x for c in fields for x in (F.lit(c), F.col(c).cast("string"))]
                parts.append(
                    self.rows(file_pattern, name, *fields).select(
                        *SOURCE, F.create_map(*pairs).alias("row")
                    )
                )
        return reduce(DataFrame.unionByName, parts)

    def files(self, path_pattern):
        return self._files.where(F.col("path").rlike(path_pattern))

    def scan(self, path_pattern, ddl, scan, whole=False):
        return scan_cells(self.files(path_pattern), list(FILE), ddl, scan)

    def settings(self, path_pattern):
        return settings(self.files(path_pattern), ["case_id", "path", "name", "sha256"])


@dataclass(frozen=True)
class Normaliser:
    name: str
    domain: str
    build: Callable[[Sources], DataFrame]

    def __call__(self, sources: Sources) -> DataFrame:
        return conform(self.build(sources), self.domain)


REGISTRY: dict[str, Normaliser] = {}


def normaliser(name: str, domain: str):
    def add(fn):
        REGISTRY[name] = Normaliser(name, domain, fn)
        return fn

    return add


def from_row(confidence: float = 1.0) -> Column:
    """Provenance of a source row."""
    return provenance(
        F.col("source_file"), F.col("source_table"), F.col("rowid"),
        confidence=confidence, sha256=F.col("sha256"), read_mode=F.col("read_mode"),
    ).alias("provenance")


def from_file(confidence: float = 1.0) -> Column:
    return provenance(
        F.col("path"), confidence=confidence, sha256=F.col("sha256")
    ).alias("provenance")


def is_one(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string") == "1", F.lit(False))
