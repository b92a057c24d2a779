"""Money summaries, activity and subject views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from .ledger import money_sum
from .skew import value_sets


def _settled() -> Column:
    return F.coalesce(F.col("settled"), F.lit(False))


def financial_summary(txns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Received, paid, what both leave out, and rows per ledger source: one pass."""
    settled = _settled()
    left_out = ~settled | F.col("direction").isNull()
    return txns.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_txns"),
        F.count_if(F.col("txn_source") == "passbook").alias("n_passbook"),
        F.count_if(F.col("txn_source") == "chat").alias("n_chat"),
        money_sum("amount", settled & (F.col("direction") == "credit")).alias("received"),
        money_sum("amount", settled & (F.col("direction") == "debit")).alias("paid"),
        F.count_if(left_out).alias("n_excluded"),
        money_sum("amount", left_out).alias("excluded_value"),
    )


def spend_by_category(txns: DataFrame, n: int = 8) -> DataFrame:
    return (
        txns.where(_settled() & (F.col("direction") == "debit"))
        .groupBy(F.coalesce(present("category_label"), F.lit("uncategorised")).alias("category"))
        .agg(money_sum("amount").alias("spent"))
        .orderBy(F.desc("spent"), "category")
        .limit(n)
    )


def txns_per_month(txns: DataFrame, utc: Column, n: int = 12) -> DataFrame:
    return (
        txns.where(utc.isNotNull())
        .groupBy(F.date_format(utc, "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n_txns"))
        .orderBy(F.desc("month"))
        .limit(n)
    )


def top_counterparties(entities: DataFrame, n: int = 5) -> DataFrame:
    """The parties with most payments."""
    return (
        entities.where((F.col("txn_count") > 0) & ~F.col("is_subject"))
        .orderBy(F.desc("txn_count"), "entity_id")
        .limit(n)
    )


def activity_series(timeline: DataFrame) -> DataFrame:
    return timeline.where("utc IS NOT NULL").select("case_id", "utc", "ref_domain", "summary").orderBy(
        "case_id", "utc", "ref_domain", "summary"
    )


def subject_profile(person: DataFrame, accounts: DataFrame, prefs: DataFrame) -> DataFrame:
    """The device owner of each case; a missing bank is filled from the linked accounts."""
    subjects = (
        person.where("is_subject")
        .groupBy("case_id")
        .agg(
            F.min_by(
                F.struct("name", "customer_id", "phone", "bank_name", "account_age_text",
                         "sendbird_id"),
                F.struct("provenance.source_file", "provenance.rowid"),
            ).alias("s")
        )
        .select("case_id", "s.*")
    )
    banks = value_sets(accounts.where(present("bank_name").isNotNull()), ["case_id"], "bank_name", "b")
    banks = banks.select("case_id", F.array_join("b", ", ").alias("banks"))
    settings = prefs.groupBy("case_id").agg(
        *[
            F.min_by("value", F.when(F.col("key") == k, F.col("provenance.source_file"))).alias(k)
            for k in ("kyc_state", "ppb_bank_type")
        ]
    )
    return (
        subjects.join(banks, "case_id", "left")
        .join(settings, "case_id", "left")
        .withColumn("bank_name", F.coalesce(present("bank_name"), "banks"))
        .drop("banks")
    )
