"""Record tables out: Parquet, JSON, CSV, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clocks import iso_time
from ..functions.text import canonical_row
from ..operators.geo import geojson_features

PROVENANCE_FIELDS = (
    "source_file", "source_table", "rowid", "byte_offset", "origin", "confidence",
    "ingest_sha256", "read_mode",
)
TIME_FIELDS = ("timestamp", "last_enqueue", "created", "expires", "start_time")


def write_domain(df: DataFrame, store: str, domain: str) -> None:
    """One folder per domain, replaced as a whole: running a job again never adds rows twice."""
    df.write.mode("overwrite").parquet(f"{store}/{domain}")


def read_domain(spark: SparkSession, store: str, domain: str) -> DataFrame:
    return spark.read.parquet(f"{store}/{domain}")


def _nested_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_time(c)
    return c.cast("string")


def csv_frame(df: DataFrame) -> DataFrame:
    """Flat text columns: provenance as ``prov.*``, times also as three sortable columns, other
    nested values as compact JSON, missing as empty."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == "raw":
            continue
        if f.name == "provenance":
            have = f.dataType.fieldNames()
            out += [
                c[p].cast("string").alias(f"prov.{p}") for p in PROVENANCE_FIELDS if p in have
            ]
            continue
        out.append(_nested_text(c, f.dataType).alias(f.name))
        if f.name in TIME_FIELDS and isinstance(f.dataType, T.StructType):
            out += [
                iso_time(c["utc"]).alias(f"{f.name}.utc_iso"),
                c["epoch_type"].alias(f"{f.name}.epoch_type"),
                c["raw"].cast("string").alias(f"{f.name}.raw"),
            ]
    flat = df.select(*out)
    return flat.na.fill("")


def export(df: DataFrame, path: str, fmt: str, order: list | None = None) -> None:
    """Write in a stable order (default: by provenance). Output is a folder of part files; each
    part is sorted and the parts follow the order, whatever the number of tasks."""
    keys = order or [c for c in ("case_id", "provenance") if c in df.columns] or df.columns[:1]
    rows = df.orderBy(*keys)
    if fmt == "json":
        rows.select(canonical_row(df.columns).alias("value")).write.mode("overwrite").text(path)
    elif fmt == "csv":
        csv_frame(rows).write.mode("overwrite").option("header", True).option(
            "escape", '"'
        ).option("emptyValue", "").csv(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")


def export_geojson(fixes: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features, one folder per case."""
    geojson_features(fixes).write.mode("overwrite").partitionBy("case_id").text(path)
