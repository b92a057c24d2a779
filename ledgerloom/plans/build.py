"""The whole job: folders of source files in, one table per record domain out."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.entities import entity_table
from ..operators.residual import harvest_files, live_identifiers, residual_identifiers
from ..operators.timeline import templates, timeline_table
from ..schemas import conform, provenance
from ..sources import files as fs
from ..sources import sqlite
from ..sources.case_tables import case_tables
from ..sources.sinks import read_domain, write_domain
from .normalisers import REGISTRY, LandedSources

RUN_LOG = "normaliser string, domain string, n_rows bigint, error string"


def _runs(df: DataFrame) -> str | None:
    """The error that evaluating ``df`` ends with, if any."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001
        return str(e)
    return None


def write_counted(df: DataFrame, store: str, domain: str, names: list[str]) -> dict[str, int]:
    """Write a domain; returns the rows of each normaliser, counted by the tasks that write them. Each task counts
    once, however often it is tried, and nothing is read back."""
    seen = Observation(domain)
    counted = [F.count_if(F.col("normaliser") == name).alias(f"n{i}") for i, name in enumerate(names)]
    write_domain(df.observe(seen, F.count(F.lit(1)).alias("n"), *counted), store, domain)
    found = seen.get
    return {name: found[f"n{i}"] for i, name in enumerate(names)}


def run_normalisers(
    spark: SparkSession, sources: LandedSources, store: str, names: list[str] | None = None
) -> DataFrame:
    """Write every domain; returns (normaliser, domain, rows) as the run log.

    A source that fails is logged with -1 and loses only its own rows: where a domain cannot be written,
    each of its sources is tried alone. Every domain is written, without rows if it has no source, and a
    source without rows is logged with 0.
    """
    by_domain, log = defaultdict(list), []
    for name, n in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            df = n(sources).withColumn("normaliser", F.lit(name))
            by_domain[n.domain].append((name, df))
        except Exception as e:  # noqa: BLE001  (schema surprises of one source)
            log.append((name, n.domain, -1, str(e)))
            by_domain[n.domain] += []
    for domain, parts in by_domain.items():
        empty = conform(spark.createDataFrame([], "case_id string"), domain).withColumn("normaliser", F.lit(None).cast("string"))

        def write() -> dict[str, int]:
            return write_counted(reduce(DataFrame.unionByName, [df for _, df in parts], empty), store, domain, [name for name, _ in parts])

        try:
            counts = write()
        except Exception:  # noqa: BLE001
            errors = {name: _runs(df) for name, df in parts}
            log += [(name, domain, -1, error) for name, error in errors.items() if error]
            parts[:] = [(name, df) for name, df in parts if not errors[name]]
            counts = write()
        log += [(name, domain, n, None) for name, n in counts.items()]
    return spark.createDataFrame(log, RUN_LOG)


def build(spark: SparkSession, cases: DataFrame, store: str, bank_defaults: DataFrame | None = None):
    """Inventory -> hashes -> landed rows -> domains -> residual, entities, timeline.

    Every stage writes its table and the next one reads it, so a lost executor costs a task and a
    failed stage can be run again. The residual pass runs before entities, as its live set is the
    parsed records.
    """
    inventory = fs.file_inventory(cases)
    inventory.write.mode("overwrite").parquet(f"{store}/_inventory")
    inventory = spark.read.parquet(f"{store}/_inventory")
    fs.save_manifest(fs.manifest(inventory), f"{store}/_manifest")
    hashes = fs.load_manifest(spark, f"{store}/_manifest").select("case_id", "path", "sha256", "is_sqlite")
    hashed = fs.artifacts(inventory).join(hashes, ["case_id", "path"], "left")

    first = F.min_by(F.struct("root", "path", "size", "sha256", "is_sqlite"), F.col("path")).alias("f")
    named = hashed.groupBy("case_id", "name").agg(first).select("case_id", "name", "f.*")
    # the first bytes tell what is a database; other files are never opened as one
    stores = named.where(F.col("is_sqlite") | F.col("name").endswith("-wal"))
    databases = sqlite.database_files(stores).join(named.where("is_sqlite").select("case_id", "path"), ["case_id", "path"], "left_semi")
    sqlite.log_deltas(databases).write.mode("overwrite").parquet(f"{store}/_log_deltas")
    sqlite.table_splits(databases).write.mode("overwrite").parquet(f"{store}/_splits")
    splits = spark.read.parquet(f"{store}/_splits")
    tables = case_tables(spark, f"{store}/_splits")
    sqlite.land(tables, f"{store}/_rows")
    landed = spark.read.schema(tables.schema).parquet(f"{store}/_rows")

    log = run_normalisers(spark, LandedSources(landed.where("error IS NULL"), hashed, bank_defaults), store)
    # unreadable files and tables, and ranges that end early, are failures too
    table = F.concat_ws("#", "path", "source_table").alias("path")
    damaged = fs.load_manifest(spark, f"{store}/_manifest").select("case_id", "path", "error").unionByName(
        splits.select("case_id", table, "error")
    ).unionByName(
        landed.withColumnRenamed("source_file", "path").select("case_id", table, "error")
    ).where("error IS NOT NULL").distinct()
    log = log.unionByName(damaged.select(
        F.concat_ws("/", "case_id", "path").alias("normaliser"), F.lit("source").alias("domain"),
        F.lit(-1).cast("bigint").alias("n_rows"), "error",
    ))
    log.write.mode("overwrite").parquet(f"{store}/_run_log")
    domains = {
        d: read_domain(spark, store, d)
        for d in {n.domain for n in REGISTRY.values()}
    }

    # databases and their write-ahead logs, where removed rows last longest
    found = residual_identifiers(harvest_files(stores, ["case_id", "path", "sha256"]), live_identifiers(domains))
    carved = found.select(
        "case_id", "kind", "value", "confidence",
        provenance(F.col("path"), byte_offset=F.col("byte_offset"), origin="carved",
                   confidence=F.col("confidence"), sha256=F.col("sha256")).alias("provenance"),
    )
    write_domain(carved, store, "carved")

    entities = entity_table(domains["person"], domains["transaction"], domains["message"])
    write_domain(entities, store, "entity")
    timed = {d: domains[d] for d in templates() if d in domains}
    timeline = timeline_table(timed)
    write_domain(conform(timeline, "timeline"), store, "timeline")
    return log
