"""One chronological table over every timed domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_present, present, short_class, truncate


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _filled(c: str) -> Column:
    return F.coalesce(present(c), F.lit(""))


def _shown(c: str) -> Column:
    """Missing values stay visible as the word None in these three templates."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _join(*parts) -> Column:
    return F.trim(F.concat(*parts))


def _number(c: str) -> Column:
    """A number in plain digits, as in 10000000.0, from 0.0001 to below 1e16."""
    number = F.col(c).cast("double")
    text = number.cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,12)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    usual = (F.abs(number) >= 1e-4) & (F.abs(number) < 1e16)
    return F.when(text.contains("E") & usual, plain).otherwise(text)


def _amount(c: str) -> Column:
    number = F.col(c).cast("double")
    return F.when(F.coalesce(number, F.lit(0.0)) == 0, "").otherwise(_number(c))



def templates() -> dict[str, tuple[str, Column]]:
    """domain -> (column that holds its event time, summary text)."""
    # The wording of the summaries.
    s = F.lit(" ")
    return {
        "transaction": (
            "timestamp",
            _join(
                _filled("direction"), s, _amount("amount"), s,
                F.coalesce(first_present("counterparty_name", "counterparty_vpa"), F.lit("")),
            ),
        ),
        "message": (
            "timestamp",
            _join(F.coalesce(present("msg_type"), F.lit("msg")), F.lit(": "), _filled("content")),
        ),
        "location": (
            "timestamp",
            F.concat(F.coalesce(_number("latitude"), F.lit("None")), F.lit(","),
                     F.coalesce(_number("longitude"), F.lit("None")), F.lit(" ("),
                     _shown("source_kind"), F.lit(")")),
        ),
        "consent": (
            "timestamp", F.concat(_shown("consent_key"), F.lit(" = "), _shown("consent_value")),
        ),
        "notification": (
            "timestamp", F.coalesce(first_present("title", "message"), F.lit("")),
        ),
        "search": ("timestamp", _filled("query")),
        "diagnostic": (
            "timestamp",
            _join(_shown("event_type"), F.lit(" v"), _shown("app_version"), s,
                  _filled("network_type")),
        ),
        "job": (
            "last_enqueue",
            _join(short_class(_text("worker_class")), F.lit(" ["), _filled("state_label"),
                  F.lit("]")),
        ),
        "crash": ("start_time", _join(F.lit("session "), _filled("session_id"))),
        "appstate": ("timestamp", _join(_filled("key"), F.lit(": "), _filled("value"))),
        "cookie": ("created", _join(_filled("host"), s, _filled("name"))),
        "channel": (
            "timestamp",
            _join(F.lit("conversation "),
                  F.coalesce(first_present("name", "channel_url"), F.lit("")), F.lit(" ("),
                  F.coalesce(F.col("message_count").cast("string"), F.lit("0")), F.lit(" msg)")),
        ),
        "webcache": ("created", truncate(_text("url"), 120)),
    }


def in_timeline(domain: str) -> Column:
    """Payments seen in chat are listed as transactions; push bookkeeping has no event time."""
    if domain == "message":
        return F.coalesce(F.col("amount").cast("double"), F.lit(0.0)) == 0
    if domain == "notification":
        bookkeeping = F.coalesce(F.col("is_dedup_record"), F.lit(False)) | F.coalesce(
            F.col("message") == "(push dedup record)", F.lit(False)
        )
        return ~bookkeeping
    return F.lit(True)


def branch(domain: str, df: DataFrame) -> DataFrame:
    time_col, summary = templates()[domain]
    return (
        df.where(F.col(time_col)["utc"].isNotNull() & in_timeline(domain))
        .select(
            "case_id",
            F.col(time_col)["utc"].alias("utc"),
            F.lit(domain).alias("event_type"),
            summary.alias("summary"),
            F.lit(domain).alias("ref_domain"),
            F.col("provenance")
            .withField("byte_offset", F.lit(None).cast("bigint"))
            .alias("provenance"),
        )
    )


def timeline_table(domains: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of the timed domains, range-sorted by (case, time, domain, summary)."""
    parts = [branch(d, domains[d]) for d in templates() if d in domains]
    union = reduce(DataFrame.unionByName, parts)
    return union.orderBy("case_id", "utc", "ref_domain", "summary")


#: domains that report the device rather than the person
DEVICE_DOMAINS = ("diagnostic", "notification")


def latest_activity(timeline: DataFrame, n: int = 12) -> DataFrame:
    return (
        timeline.where(~F.col("ref_domain").isin(*DEVICE_DOMAINS))
        .orderBy(F.desc("utc"), "ref_domain", "summary")
        .limit(n)
    )
