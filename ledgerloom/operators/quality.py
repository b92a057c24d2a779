"""Reconciliation and data-quality checks. Each one is a small aggregate over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import label
from ..functions.parties import MOBILE, RRN
from ..functions.secrets import token_shaped
from ..functions.text import present
from .skew import scan_in_order


def failed_sources(run_log: DataFrame) -> DataFrame:
    """Sources whose run ended with an error (a negative row count)."""
    return run_log.where("n_rows < 0")


def reconcile_counts(
    raw: DataFrame, emitted: DataFrame, keys: Sequence[str], domain: str, join_only: Sequence[str] = ()
) -> DataFrame:
    """Source rows against emitted rows per key. A source that feeds several domains is compared
    with the largest of them; tables read only to be joined are not expected to emit rows."""
    a = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"))
    per_domain = emitted.groupBy(*keys, domain).agg(F.count(F.lit(1)).alias("n"))
    b = per_domain.groupBy(*keys).agg(F.max("n").alias("n_emitted"))
    joined = a.join(b, list(keys), "full").na.fill(0, ["n_raw", "n_emitted"])
    if join_only:
        joined = joined.where(~F.coalesce(F.col(keys[-1]).isin(*join_only), F.lit(False)))
    verdict = (
        F.when(F.col("n_raw") == F.col("n_emitted"), "complete")
        .when(F.col("n_raw") > F.col("n_emitted"), "rows missing")
        .otherwise("rows added")
    )
    return joined.withColumn("verdict", verdict)


def reconcile_fields(truth: DataFrame, found: DataFrame, on: Sequence[str], columns: Sequence[str]):
    """Mismatches per column between two tables with the same keys, as (field, counts) rows."""
    other = found.select(*on, *[F.col(c).alias(f"_f_{c}") for c in columns])
    both = truth.select(*on, *columns).join(other, list(on))
    counts = both.agg(
        F.count(F.lit(1)).alias("n_compared"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_f_{c}"))).alias(c) for c in columns],
    )
    return counts.unpivot(["n_compared"], list(columns), "field", "n_mismatch")


def enum_census(df: DataFrame, field: str, column: Column, table: dict[int, str]) -> DataFrame:
    """Values of a coded column, how often, and whether the code table knows them."""
    counts = df.groupBy(column.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = F.coalesce(~label(table, "value").startswith("code:"), F.lit(False))
    return counts.select(F.lit(field).alias("field"), "value", "n", known.alias("mapped"))


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How two id spaces overlap: one row of counts over distinct ids."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count("_l").alias("n_left"),
        F.count("_r").alias("n_right"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"),
    )


def timestamp_census(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, kinds and range of every decoded time field: name -> (frame, struct column)."""
    parts = [
        df.groupBy(F.lit(name).alias("field"), F.col(f"{column}.epoch_type").alias("epoch_type")).agg(
            F.count(F.lit(1)).alias("n"),
            F.min(f"{column}.utc").alias("first_utc"),
            F.max(f"{column}.utc").alias("last_utc"),
        )
        for name, (df, column) in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def token_positions(df: DataFrame, column: str, shape: str = RRN) -> DataFrame:
    """Where in a comma list the expected token sits: last, elsewhere, or nowhere."""
    tokens = F.transform(F.split(F.col(column), ","), lambda t: F.trim(t))
    last = F.coalesce(F.element_at(tokens, -1).rlike(shape), F.lit(False))
    anywhere = F.coalesce(F.exists(tokens, lambda t: t.rlike(shape)), F.lit(False))
    return df.where(present(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_lists"),
        F.count_if(last).alias("n_last"),
        F.count_if(anywhere & ~last).alias("n_elsewhere"),
        F.count_if(~anywhere).alias("n_none"),
        F.count_if(F.coalesce(F.exists(tokens, lambda t: t.rlike(MOBILE)), F.lit(False))).alias(
            "n_with_mobile"
        ),
    )


def _filled(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    return c.isNotNull()


def field_coverage(df: DataFrame, shown: Sequence[str]) -> DataFrame:
    """Populated columns and whether a reader ever gets to see them (one pass, no pivoting)."""
    fields = [f for f in df.schema.fields if f.name not in ("provenance", "raw", "case_id")]
    counts = df.agg(
        F.lit(1).alias("_one"),
        *[F.count_if(_filled(f.name, f.dataType)).alias(f.name) for f in fields],
    )
    long = counts.unpivot(["_one"], [f.name for f in fields], "field", "n_filled").drop("_one")
    return long.withColumn("shown", F.col("field").isin(*shown))


def inversions(df: DataFrame, keys: Sequence[str], order: Sequence[str], when: str):
    """Per key: neighbouring rows whose time runs backwards."""
    lagged = scan_in_order(df.select(*dict.fromkeys([*keys, *order, when])), keys, order, {"_before": when})
    return lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_before") > F.col(when)).alias("n_inversions"),
    )


def unrepresented_domains(domains: DataFrame, timed: Sequence[str] | None, timeline: DataFrame):
    """Domains that have rows and can carry a time (all, if None), yet never reach the timeline."""
    can = F.lit(True) if timed is None else F.col("domain").isin(*timed)
    expected = domains.where(can & (F.col("n") > 0)).select("domain")
    return expected.exceptAll(timeline.select(F.col("ref_domain").alias("domain")).distinct())


def shared_identifiers(keys: DataFrame, owner: str, key_cols: Sequence[str]) -> DataFrame:
    """Identifiers that ended up in more than one entity (there should be none)."""
    return (
        keys.select(*key_cols, owner)
        .distinct()
        .groupBy(*key_cols)
        .agg(F.count(F.lit(1)).alias("n_owners"))
        .where("n_owners > 1")
    )


def ledger_checks(primary: DataFrame, second: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Duplicate ids, overlap of the two sources and rows without a key, as one row."""
    sizes = merged.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    repeated = sizes.agg(F.count_if(F.col("n") > 1))
    shared = key_overlap(primary, second, key).select("n_both")
    return merged.agg(F.count_if(F.col(key).isNull()).alias("n_without_key")).select(
        repeated.scalar().alias("n_duplicate_ids"),
        shared.scalar().alias("n_in_both_sources"),
        "n_without_key",
    )


def timeline_completeness(txns: DataFrame, timeline: DataFrame, key: str) -> DataFrame:
    """Every timed ledger row is listed once: counts of rows, listed, repeated and absent."""
    listed = timeline.groupBy(key).agg(F.count(F.lit(1)).alias("n_listed"))
    return (
        txns.select(key)
        .join(listed, key, "left")
        .agg(
            F.count(F.lit(1)).alias("n_ledger_rows"),
            F.count_if(F.col("n_listed").isNotNull()).alias("n_listed"),
            F.count_if(F.coalesce("n_listed", F.lit(0)) > 1).alias("n_repeated"),
            F.count_if(F.col("n_listed").isNull()).alias("n_absent"),
        )
    )


def attribution_gaps(df: DataFrame) -> DataFrame:
    """Records without a source file or without the hash of that file."""
    p = F.col("provenance")
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(present(p["source_file"]).isNull()).alias("n_without_source"),
        F.count_if(present(p["ingest_sha256"]).isNull()).alias("n_without_hash"),
    )


def manifest_checks(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).alias(
            "n_bad_sha256"
        ),
        F.count_if(~F.coalesce(F.col("md5").rlike("^[0-9a-f]{32}$"), F.lit(False))).alias("n_bad_md5"),
        F.count_distinct("path").alias("n_paths"),
    )


def source_coverage(files: DataFrame, read: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Share of files per group that some parser read."""
    seen = read.select(key).distinct().withColumn("_read", F.lit(True))
    n_read = F.count_if(F.coalesce("_read", F.lit(False)))
    return (
        files.join(seen, key, "left")
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            n_read.alias("n_read"),
            F.round(n_read * 100.0 / F.count(F.lit(1)), 1).alias("pct_read"),
        )
    )


# Identifier shapes that must not be published.
LEAK_SHAPES = {
    "mobile": r"(?<![0-9a-fA-F])[6-9][0-9]{9}(?![0-9a-fA-F])",
    "rrn": r"(?<![0-9a-fA-F])[0-9]{12}(?![0-9a-fA-F])",
    "long_id": r"(?<![0-9a-fA-F])[0-9]{19}(?![0-9a-fA-F])",
}


def leak_counts(
    texts: DataFrame, by: Sequence[str], text: str, literals: Sequence[str], waived: Column
) -> DataFrame:
    """Texts per group with an identifier shape or a known literal value.

    ``waived`` excuses a text from the shapes (synthetic samples) but never from the literals.
    ``literals`` is a short hand-written list, given at plan time.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    excused = F.coalesce(waived, F.lit(False))
    tests = {k: t.rlike(p) & ~excused for k, p in LEAK_SHAPES.items()}
    tests["literal"] = reduce(
        lambda a, b: a | b, [F.contains(t, F.lit(v)) for v in literals], F.lit(False)
    )
    return texts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        *[F.count_if(test).alias(f"n_{kind}") for kind, test in tests.items()],
    )


def assert_no_leaks(counts: DataFrame) -> None:
    """Gate: raises when any group has a hit. Only the totals come to the driver."""
    kinds = [c for c in counts.columns if c.startswith("n_") and c != "n_texts"]
    totals = counts.agg(*[F.sum(c).alias(c) for c in kinds]).first().asDict()
    hits = {k: v for k, v in totals.items() if v}
    if hits:
        raise ValueError(f"possible identifiers found: {hits}")


def token_hygiene(domains: dict[str, DataFrame]) -> DataFrame:
    """Token-shaped values that reached a text column unredacted, per domain and field."""
    parts = []
    for domain, df in sorted(domains.items()):
        fields = [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ("raw", "case_id")
        ]
        if not fields:
            continue
        counts = df.agg(
            F.lit(domain).alias("domain"), *[F.count_if(token_shaped(c)).alias(c) for c in fields]
        )
        parts.append(counts.unpivot(["domain"], fields, "field", "n_hits"))
    return reduce(DataFrame.unionByName, parts).where("n_hits > 0")
