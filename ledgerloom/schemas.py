"""Record types: one table per domain, every row with its provenance."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = (
    "struct<source_file:string,source_table:string,rowid:bigint,byte_offset:bigint,"
    "origin:string,confidence:double,ingest_sha256:string,read_mode:string>"
)
TIME = "struct<raw:string,epoch_type:string,utc:timestamp>"
ORIGINS = ("live", "carved")

# Fields of each record domain, in order.
DOMAINS = {
    "person": "customer_id string, name string, phone string, country_code string, "
    "vpas array<string>, person_type string, is_subject boolean, account_age_text string, "
    "sendbird_id string, bank_name string, masked_account string, verified_name string",
    "account": "bank_name string, ifsc_or_branch string, account_type string, "
    "masked_number string, instrument_type bigint",
    "transaction": "txn_id string, source_txn_id string, amount double, direction string, "
    "counterparty_vpa string, counterparty_name string, counterparty_mobile string, rrn string, "
    "account_used string, account_type string, account_bank string, account_branch string, "
    "payment_mode string, status_raw string, status_label string, category_raw string, "
    "category_label string, tag string, narration string, instrument string, error_code string, "
    "error_message string, settled boolean, txn_source string, note string, "
    f"timestamp {TIME}",
    "message": "channel_url string, chat_with string, sender_id string, sender_name string, "
    "msg_type string, content string, amount double, rrn string, status string, "
    f"encrypted_blob_present boolean, timestamp {TIME}",
    "channel": "channel_url string, name string, member_count bigint, message_count bigint, "
    f"has_messages boolean, timestamp {TIME}",
    "location": "latitude double, longitude double, speed double, source_kind string, "
    f"pincode string, timestamp {TIME}",
    "consent": "consent_key string, consent_value string, synced_with_server boolean, "
    f"timestamp {TIME}",
    "job": "worker_class string, job_names array<string>, tags array<string>, "
    f"state string, state_label string, last_enqueue {TIME}, interval_ms bigint, "
    "run_attempt_count bigint",
    "notification": "title string, message string, deep_link string, campaign_id string, "
    f"push_id string, expiry {TIME}, is_dedup_record boolean, timestamp {TIME}",
    "search": f"query string, vertical_id string, url string, timestamp {TIME}",
    "config": "key string, kind string, meaning string, value string, "
    "is_changed_from_default boolean",
    "diagnostic": "event_type string, customer_id string, device_id string, app_version string, "
    "network_type string, message string, flow_name string, screen_name string, "
    "error_code string, error_message string, battery_pct bigint, network_carrier string, "
    "process_state string, is_rooted boolean, session_id string, latitude double, "
    f"longitude double, timestamp {TIME}",
    "encrypted": "name string, size bigint, owning_module string, reason string, cipher string, "
    "keystore_alias string",
    "appstate": f"key string, value string, detail string, timestamp {TIME}",
    "crash": f"session_id string, user_id string, start_time {TIME}, preview string",
    "pref": "key string, value string, pref_file string",
    "capability": "category string, name string, value string, available boolean",
    "timeline": "utc timestamp, event_type string, summary string, ref_domain string",
    "cookie": "host string, name string, value string, is_secure boolean, is_httponly boolean, "
    f"created {TIME}, expires {TIME}",
    "webcache": "url string, method string, user_id string, size bigint, body_preview string, "
    f"created {TIME}",
    "webstorage": "origin string, key string, value string, store_kind string, "
    "best_effort boolean",
}


def domain_ddl(domain: str) -> str:
    return f"case_id string, {DOMAINS[domain]}, provenance {PROVENANCE}, raw string"


@lru_cache(maxsize=None)
def _domain_schema(domain: str) -> T.StructType:
    return T.StructType.fromDDL(domain_ddl(domain))


def conform(df: DataFrame, domain: str) -> DataFrame:
    """Exactly the columns of a domain: missing ones become null, extra ones are dropped."""
    target = _domain_schema(domain)
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def provenance(
    source_file: Column | str,
    source_table: Column | str | None = None,
    rowid: Column | None = None,
    byte_offset: Column | None = None,
    origin: str = "live",
    confidence: Column | float = 1.0,
    sha256: Column | None = None,
    read_mode: Column | None = None,
) -> Column:
    if origin not in ORIGINS:
        raise ValueError(f"unknown origin {origin!r}")

    def as_col(v, kind):
        c = v if isinstance(v, Column) else F.lit(v)
        return c.cast(kind)

    return F.struct(
        as_col(source_file, "string").alias("source_file"),
        as_col(source_table, "string").alias("source_table"),
        as_col(rowid, "bigint").alias("rowid"),
        as_col(byte_offset, "bigint").alias("byte_offset"),
        F.lit(origin).alias("origin"),
        as_col(confidence, "double").alias("confidence"),
        as_col(sha256, "string").alias("ingest_sha256"),
        as_col(read_mode, "string").alias("read_mode"),
    )
