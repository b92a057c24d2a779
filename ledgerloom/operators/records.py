"""Views over record tables: display columns, summaries, search, sorting, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clocks import iso_time, show_time
from ..functions.masks import mask_frame
from ..functions.text import present, truncate
from .filters import NOT_SEARCHED, text_matches

# Columns shown per domain, in order.
DISPLAY_COLUMNS = {
    "transaction": [
        "timestamp", "amount", "direction", "settled", "txn_source", "counterparty_name",
        "counterparty_vpa", "counterparty_mobile", "rrn", "account_used", "account_bank",
        "account_branch", "account_type", "status_label", "category_label", "tag", "instrument",
        "payment_mode", "error_code", "error_message", "note", "narration", "txn_id",
        "source_txn_id",
    ],
    "account": ["bank_name", "ifsc_or_branch", "account_type", "masked_number", "instrument_type"],
    "channel": ["timestamp", "name", "channel_url", "member_count", "message_count", "has_messages"],
    "message": [
        "timestamp", "chat_with", "msg_type", "sender_name", "sender_id", "amount", "rrn",
        "status", "encrypted_blob_present", "content", "channel_url",
    ],
    "person": [
        "name", "person_type", "customer_id", "phone", "vpas", "sendbird_id", "verified_name",
        "masked_account", "account_age_text", "bank_name", "country_code", "is_subject",
    ],
    "entity": [
        "names", "person_type", "phones", "vpas", "customer_ids", "sendbird_ids", "txn_count",
        "total_received", "total_paid", "msg_count", "account_age_text", "is_subject",
        "source_files",
    ],
    "location": ["timestamp", "latitude", "longitude", "speed", "source_kind", "pincode"],
    "consent": ["timestamp", "consent_key", "consent_value", "synced_with_server"],
    "job": [
        "last_enqueue", "job_names", "worker_class", "tags", "state", "state_label",
        "interval_ms", "run_attempt_count",
    ],
    "notification": ["timestamp", "title", "message", "deep_link", "campaign_id", "push_id"],
    "search": ["timestamp", "query", "vertical_id", "url"],
    "config": ["key", "kind", "meaning", "value", "is_changed_from_default"],
    "diagnostic": [
        "timestamp", "event_type", "message", "flow_name", "screen_name", "error_code",
        "error_message", "latitude", "longitude", "network_type", "network_carrier",
        "battery_pct", "process_state", "is_rooted", "app_version", "customer_id", "device_id",
        "session_id",
    ],
    "encrypted": ["name", "size", "owning_module", "cipher", "keystore_alias", "reason"],
    "pref": ["pref_file", "key", "value"],
    "carved": ["kind", "value", "confidence"],
    "timeline": ["utc", "event_type", "summary", "ref_domain"],
    "cookie": ["host", "name", "value", "is_secure", "is_httponly", "created", "expires"],
    "webstorage": ["store_kind", "origin", "key", "value", "best_effort"],
    "capability": ["category", "name", "available", "value"],
    "webcache": ["created", "url", "method", "user_id", "size", "body_preview"],
    "appstate": ["timestamp", "key", "value", "detail"],
    "crash": ["start_time", "session_id", "user_id", "preview"],
}


def display_columns(domain: str, schema: T.StructType) -> list[str]:
    wanted = DISPLAY_COLUMNS.get(domain)
    present_cols = [f for f in schema.fieldNames() if f not in NOT_SEARCHED]
    return [c for c in wanted if c in present_cols] if wanted else present_cols


def show_cell(value: Column, kind: T.DataType) -> Column:
    """Text of one cell: readable time, comma-joined list, empty for missing."""
    if isinstance(kind, T.StructType) and "utc" in kind.fieldNames():
        shown = F.coalesce(show_time(value["utc"]), value["raw"].cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        shown = show_time(value)
    elif isinstance(kind, T.ArrayType):
        shown = F.array_join(value.cast("array<string>"), ", ")
    elif isinstance(kind, (T.StructType, T.MapType)):
        shown = F.to_json(value)
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit(""))


def display_frame(domain: str, df: DataFrame, masked: bool = False, names: str | None = None):
    """The display columns as text; masking happens on demand and never in the stored table."""
    source = mask_frame(df, names) if masked else df
    cols = display_columns(domain, source.schema)
    return source.select(*[show_cell(F.col(c), source.schema[c].dataType).alias(c) for c in cols])


# Groups of fields that summarise a record; the first group with any value wins.
SUMMARY_GROUPS = (
    ("amount", "direction", "counterparty_name"),
    ("content", "chat_with"),
    ("name", "phone"),
    ("names",),
    ("title", "message"),
    ("query",),
    ("consent_key", "consent_value"),
    ("worker_class", "state_label"),
    ("key", "value"),
    ("category", "name"),
    ("latitude", "longitude"),
    ("event_type", "message"),
    ("summary",),
    ("host", "name"),
)


def summary_line(domain: str, schema: T.StructType) -> Column:
    options = []
    for group in SUMMARY_GROUPS:
        cells = [
            present(show_cell(F.col(c), schema[c].dataType))
            for c in group
            if c in schema.fieldNames()
        ]
        if cells:
            options.append(F.nullif(F.concat_ws(" · ", *cells), F.lit("")))
    return truncate(F.coalesce(*options, F.lit(domain)), 120)


def search_hits(domain: str, df: DataFrame, text: str, masked: bool = False) -> DataFrame:
    """(domain, record_key, summary) of matching records. The match sees real values; only then is
    the row masked, so a masked view can still be searched."""
    hits = df.where(text_matches(df.schema, text))
    shown = mask_frame(hits) if masked else hits
    order = "provenance" if "provenance" in df.columns else df.columns[0]
    return shown.select(
        F.lit(domain).alias("domain"),
        F.to_json(F.struct(order)).alias("record_key"),
        summary_line(domain, shown.schema).alias("summary"),
    )


def global_search(domains: dict[str, DataFrame], text: str, limit: int = 1000, masked: bool = False):
    """First ``limit`` hits over all domains in alphabetical order (a top-k, not a full sort)."""
    wanted = text.strip()
    if not wanted:
        raise ValueError("search text is empty")
    parts = [search_hits(d, df, wanted, masked) for d, df in sorted(domains.items())]
    return reduce(DataFrame.unionByName, parts).orderBy("domain", "record_key").limit(limit)


def _number(text: Column) -> Column:
    """The number that a text of plain digits stands for."""
    return F.when(text.rlike(r"^[+-]?[0-9]+([.][0-9]+)?$"), text.cast("double"))


def _grid_rank(text: Column, number: Column) -> Column:
    return F.when(text.isNull(), 0).when(number.isNotNull(), 1).otherwise(2)


def sort_keys(column: str, schema: T.StructType, descending: bool = False) -> list[Column]:
    """Grid order: empty cells first, then numbers, then text without regard to case.

    A text column may hold numbers and words side by side: digits are compared as numbers. Booleans count as
    numbers. Times sort by instant; one that could not be read sorts by its raw value, numbers before all instants.
    """
    kind = schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.StructType) and "utc" in kind.fieldNames():
        raw = present(value["raw"]) if "raw" in kind.fieldNames() else F.lit(None).cast("string")
        readable = value["utc"].isNotNull()
        number = F.when(~readable, _number(raw))
        keys = [_grid_rank(F.coalesce(value["utc"].cast("string"), raw), number), number,
                F.when(readable, iso_time(value["utc"])).otherwise(F.lower(raw))]
    elif isinstance(kind, T.ArrayType):
        keys = [F.nullif(F.lower(F.array_join(value.cast("array<string>"), ", ")), F.lit(""))]
    elif isinstance(kind, T.StringType):
        text = present(value)
        number = _number(text)
        keys = [_grid_rank(text, number), number, F.lower(text)]
    else:
        keys = [value]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def preview(df: DataFrame, order: list, n: int = 500) -> DataFrame:
    """First ``n`` rows plus, on each, how many more there are."""
    total = df.agg(F.count(F.lit(1)))
    more = F.greatest(total.scalar() - F.lit(n), F.lit(0))
    return df.orderBy(*order).limit(n).withColumn("more_rows", more)


def domain_counts(domains: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(d).alias("domain"), "n")
        for d, df in sorted(domains.items())
    ]
    return reduce(DataFrame.unionByName, parts)
