"""Conversation view over chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chattext import payment_status, payment_verb
from .skew import lookup_salted, scan_in_order


def conversations(messages: DataFrame, subject: DataFrame) -> DataFrame:
    """One row per channel: title, size, first and last time.

    ``subject`` is (case_id, subject_id). Title: resolved counterparty, else the first sender who
    is not the subject, else a constant.
    """
    m = lookup_salted(
        messages.where(F.col("channel_url").isNotNull()), subject, ["case_id"], ["channel_url", "content"]
    )
    when = F.struct(F.col("timestamp.utc"), F.col("provenance.rowid"))
    named = F.coalesce(F.col("chat_with"), F.lit("")) != ""
    other = (F.coalesce("sender_name", F.lit("")) != "") & ~F.col("sender_id").eqNullSafe(
        F.col("subject_id")
    )
    return m.groupBy("case_id", "channel_url").agg(
        F.coalesce(
            F.min_by("chat_with", F.when(named, when)),
            F.min_by("sender_name", F.when(other, when)),
            F.lit("Outgoing (merchant)"),
        ).alias("title"),
        F.count(F.lit(1)).alias("n_messages"),
        F.min("timestamp.utc").alias("first_utc"),
        F.max("timestamp.utc").alias("last_utc"),
    )


def thread(messages: DataFrame, subject: DataFrame) -> DataFrame:
    """Messages with day breaks and payment wording; order by (channel, time, rowid) to read."""
    m = messages.where(F.col("channel_url").isNotNull()).select(
        "*", F.col("timestamp.utc").alias("utc"), F.col("provenance.rowid").alias("rowid")
    )
    m = lookup_salted(m, subject, ["case_id"], ["channel_url", "rowid"])
    m = m.withColumn("order_utc", F.coalesce("utc", F.lit("0001-01-01").cast("timestamp")))
    m = scan_in_order(m, ["case_id", "channel_url"], ["order_utc", "rowid"], {"previous_utc": "utc"})
    outgoing = F.col("sender_id").eqNullSafe(F.col("subject_id"))
    paid = F.coalesce(F.col("amount"), F.lit(0.0)) != 0
    return m.select(
        *messages.columns,
        outgoing.alias("outgoing"),
        F.coalesce(
            ~F.to_date("utc").eqNullSafe(F.to_date("previous_utc")) & F.col("utc").isNotNull(),
            F.lit(False),
        ).alias("new_day"),
        payment_status("msg_type", "content").alias("payment_status"),
        F.when(paid, payment_verb("msg_type", "content", outgoing)).alias("payment_verb"),
    )
