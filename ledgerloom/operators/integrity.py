"""Content digests, manifests, snapshot differences and hash-chained logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_row
from .skew import scan_in_order

GENESIS = "0" * 64


def content_digest(df: DataFrame, key: str, content: str) -> DataFrame:
    body = F.col(content).cast("binary")
    return df.select(
        F.col(key),
        F.sha2(body, 256).alias("sha256"),
        F.md5(body).alias("md5"),
        F.length(body).cast("bigint").alias("size"),
    )


def manifest_diff(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """changed / missing / added paths. A file that could not be hashed on one side counts as
    changed; equal hashes and two unreadable copies do not."""
    a = old.select(*on, F.col("sha256").alias("old_sha256"), F.lit(True).alias("_old"))
    b = new.select(*on, F.col("sha256").alias("new_sha256"), F.lit(True).alias("_new"))
    status = (
        F.when(F.col("_new").isNull(), "missing")
        .when(F.col("_old").isNull(), "added")
        .when(~F.col("old_sha256").eqNullSafe(F.col("new_sha256")), "changed")
    )
    return (
        a.join(b, list(on), "full")
        .select(*on, status.alias("status"), "old_sha256", "new_sha256")
        .where("status IS NOT NULL")
    )


def row_count_delta(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group in two snapshots, where they differ. Net counts, not a row-level diff."""
    a = before.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy(*by).agg(F.count(F.lit(1)).alias("n_after"))
    change = F.col("n_after") - F.col("n_before")
    return (
        a.join(b, list(by), "full")
        .na.fill(0, ["n_before", "n_after"])
        .where("n_before <> n_after")
        .select(
            *by,
            "n_before",
            "n_after",
            F.greatest(change, F.lit(0)).alias("net_hidden"),
            F.greatest(-change, F.lit(0)).alias("net_deleted"),
        )
    )


def table_digest(df: DataFrame, bucket: Column, columns: list[str]) -> DataFrame:
    """Order-free digest per bucket: row hashes are summed, so no bucket is gathered anywhere."""
    row_hash = F.conv(F.left(F.md5(canonical_row(columns).cast("binary")), F.lit(15)), 16, 10)
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(row_hash.cast("decimal(20,0)")).cast("string").alias("digest"),
    )


# ---- hash-chained logs -----------------------------------------------------------------------


def entry_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat(previous, body).cast("binary"), 256)


def chain_breaks(
    entries: DataFrame, keys: Sequence[str], order: Sequence[str], sorted_before: bool = False
) -> DataFrame:
    """Entries (prev_hash, expected_hash, entry_hash) that break their chain, with the reason. ``sorted_before``
    as in :func:`~.skew.scan_in_order`.
    An entry without a hash does not begin a new chain: the next one must name the last hash before it."""
    linked = scan_in_order(entries, keys, order, {"_before": "entry_hash"}, skip_nulls=True, sorted_before=sorted_before)
    loose = ~F.col("prev_hash").eqNullSafe(F.coalesce("_before", F.lit(GENESIS)))
    edited = ~F.col("expected_hash").eqNullSafe(F.col("entry_hash"))
    reasons = F.array_compact(
        F.array(
            F.when(loose, "prev_hash does not chain"),
            F.when(edited, "entry_hash mismatch (edited?)"),
        )
    )
    return linked.select(*keys, *order, F.explode(reasons).alias("reason"))


_ENTRY = (
    "log string, block bigint, place bigint, valid boolean, prev_hash string, "
    "expected_hash string, entry_hash string"
)


def _read_entries(batches):
    for pdf in batches:
        rows = []
        for log, block, place, line in pdf.itertuples(index=False):
            try:
                entry = json.loads(line)
                stored = entry.pop("entry_hash", None)
            except (ValueError, AttributeError):
                rows.append((log, block, place, False, None, None, None))
                continue
            body = json.dumps(entry, sort_keys=True, ensure_ascii=False)
            before = entry.get("prev_hash") or ""
            digest = hashlib.sha256((before + body).encode("utf-8")).hexdigest()
            rows.append((log, block, place, True, entry.get("prev_hash"), digest, stored))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRY.split(", ")])


def verify_logs(spark: SparkSession, path: str) -> DataFrame:
    """(log, block, place, reason) of every bad line in NDJSON audit logs; none means intact.

    The stored hashes cover Python's own JSON spelling, so only that re-spelling runs in Python.
    Lines keep their order through (block start, place inside the scan), however a log is split.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("log"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            "value",
        )
        .where(F.trim("value") != "")
    )
    entries = lines.mapInPandas(_read_entries, _ENTRY)
    bad_json = entries.where(~F.col("valid")).select(
        "log", "block", "place", F.lit("not valid JSON").alias("reason")
    )
    return chain_breaks(entries.where("valid"), ["log"], ["block", "place"]).unionByName(bad_json)
