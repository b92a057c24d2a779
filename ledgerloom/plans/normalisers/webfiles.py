"""Browser stores, sealed stores, crash sessions and serialized files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.clocks import decode_epoch, http_date
from ...functions.parties import ciphertext_shaped
from ...functions.secrets import redact_text, redaction
from ...functions.text import json_text, present
from ...sources.embedded import json_after, json_objects, json_responses
from ...sources.files import byte_text, printable_strings
from ...sources.scan import printable, storage_entries
from .base import Sources, from_file, from_row, is_one, normaliser

FILE_KEYS = ["case_id", "path", "name", "sha256"]


@normaliser("webview.cookies", "cookie")
def cookies(src: Sources) -> DataFrame:
    rows = src.rows(
        r"^Cookies$", "cookies",
        "host_key", "name", "value", "is_secure", "is_httponly", "creation_utc", "expires_utc",
    )
    return rows.select(
        "case_id",
        F.col("host_key").alias("host"),
        "name",
        redact_text("value").alias("value"),
        is_one("is_secure").alias("is_secure"),
        is_one("is_httponly").alias("is_httponly"),
        decode_epoch("creation_utc", "webkit_us").alias("created"),
        decode_epoch("expires_utc", "webkit_us").alias("expires"),
        from_row(),
        "raw",
    )


@normaliser("webview.cache", "webcache")
def web_cache(src: Sources) -> DataFrame:
    files = src.files(r"(?i)service worker/cachestorage.*_0$")
    found = json_responses(files, [*FILE_KEYS, "size"]).withColumn(
        "at", present(json_text("body", "$.created"))
    )
    return found.select(
        "case_id",
        "url",
        json_text("body", "$.method").alias("method"),
        json_text("body", "$.userId").alias("user_id"),
        "size",
        redact_text("body").alias("body_preview"),
        F.when(F.col("at").isNotNull(), decode_epoch("at")).alias("created"),
        from_file(0.7),
    )


@normaliser("webview.localstorage", "webstorage")
def local_storage(src: Sources) -> DataFrame:
    entries = src.scan(r"(?i)storage.*\.(ldb|log)$", "offset bigint, web_origin string, key string, value string", storage_entries, whole=True)
    # the first value of a pair in a file wins
    pairs = entries.groupBy(*FILE_KEYS, "web_origin", "key").agg(F.min_by(F.struct("value"), "offset").alias("first"))
    kind = F.when(
        F.lower("path").contains("session storage"), "session_storage"
    ).otherwise("local_storage")
    return pairs.select(
        "case_id",
        F.col("web_origin").alias("origin"),
        "key",
        redact_text("first.value").alias("value"),
        kind.alias("store_kind"),
        F.lit(True).alias("best_effort"),
        from_file(0.5),
    )


def path_origin(path: Column) -> Column:
    """Web origin out of a database folder name, else the path."""
    folder = F.regexp_extract(path, r"(?i)(https?_[^/]+?)_[0-9]+\.indexeddb", 1)
    return F.when(folder != "", F.regexp_replace(folder, "^([^_]*)_", "$1://")).otherwise(path)


@normaliser("webview.indexeddb", "webstorage")
def indexed_db(src: Sources) -> DataFrame:
    found = src.scan(r"(?i)indexeddb.*\.(ldb|log)$", "offset bigint, value string", printable(5))
    strings = found.withColumn("value", F.trim("value")).where(F.length("value") >= 8)
    return strings.select(*FILE_KEYS, "value").distinct().select(
        "case_id",
        path_origin(F.col("path")).alias("origin"),
        F.col("name").alias("key"),
        redact_text("value").alias("value"),
        F.lit("indexed_db").alias("store_kind"),
        F.lit(True).alias("best_effort"),
        from_file(0.4),
    )


@normaliser("webview.webdata", "appstate")
def web_data(src: Sources) -> DataFrame:
    rows = src.any_table(r"^Web Data$", ".")
    filled = F.map_filter("row", lambda k, v: F.coalesce(v, F.lit("")) != "")
    return rows.where(F.size(filled) > 0).select(
        "case_id",
        F.concat(F.lit("webdata."), F.col("source_table")).alias("key"),
        redact_text(F.to_json(filled)).alias("value"),
        from_row(),
        "raw",
    )


# ---- sealed stores ---------------------------------------------------------------------------

# Stores whose key never leaves the device hardware.
SEALED_STORES = (
    (
        "Data.xml",
        "Wallet secure store",
        "AES-256-GCM data key wrapped by RSA private key held in AndroidKeyStore (TEE) — private key non-exportable",
        "AES-256-GCM + RSA-2048-OAEP-SHA256",
        "NPCI-UPI/wallet",
    ),
    (
        "DataUPI.xml",
        "NPCI UPI security component",
        "AES-256-GCM data key wrapped by RSA private key held in AndroidKeyStore (TEE); store also HMAC-integrity-checked",
        "AES-256-GCM + RSA-2048-OAEP-SHA256",
        "NPCI-UPI",
    ),
    (
        "DataERUPEE.xml",
        "NPCI e-Rupee security component",
        "Same TEE-bound RSA-wrapped AES-GCM scheme as DataUPI",
        "AES-256-GCM + RSA-2048-OAEP-SHA256",
        "NPCI-ERUPEE",
    ),
)
CACHE_REASON = (
    "Base64 ciphertext at rest; decryption key not present in extraction (no offline recovery)"
)


@normaliser("encrypted.catalogue", "encrypted")
def sealed_stores(src: Sources) -> DataFrame:
    """Presence, size and reason only: no content of a sealed store is emitted."""
    known = {s[0]: s[1:] for s in SEALED_STORES}
    files = src.files(r"(^|/)Data(UPI|ERUPEE)?\.xml$")

    def fact(i: int) -> Column:
        return F.element_at(
            F.create_map(*[F.lit(x) for n, f in known.items() for x in (n, f[i])]), F.col("name")
        )

    head = byte_text("content")
    first = F.min_by(F.struct("path", "size", "sha256", head.alias("head")), F.col("path"))
    stores = (
        files.groupBy("case_id", "name")
        .agg(first.alias("f"))
        .select("case_id", "name", "f.*")
        .select(
            "case_id",
            "name",
            "size",
            fact(0).alias("owning_module"),
            fact(1).alias("reason"),
            fact(2).alias("cipher"),
            fact(3).alias("keystore_alias"),
            from_file(),
            F.to_json(
                F.struct(
                    F.regexp_count("head", F.lit('name="([^"]+)"')).alias(
                        "entry_count_in_header"
                    ),
                    F.ltrim("head").startswith("<").alias("is_xml"),
                )
            ).alias("raw"),
        )
    )
    caches = src.files(r"^shared_jsons/.*\.(?i:json)$")
    # the whole body has to look like ciphertext, not only its beginning
    sealed = caches.where(ciphertext_shaped(byte_text("content"))).select(
        "case_id",
        "name",
        "size",
        F.lit("Vertical JSON cache").alias("owning_module"),
        F.lit(CACHE_REASON).alias("reason"),
        F.lit("unknown (app-managed)").alias("cipher"),
        F.lit(None).cast("string").alias("keystore_alias"),
        from_file(),
        F.lit("{}").alias("raw"),
    )
    return stores.unionByName(sealed)


# ---- serialized files ------------------------------------------------------------------------

TOKEN_MARKER = "accessToken"


def redact_after_marker(strings: Column, marker: str = TOKEN_MARKER) -> Column:
    """Strings of one file with the marked one and the one right after a marker cut to a length."""
    return F.transform(
        strings,
        lambda s, i: F.when(
            F.contains(s, F.lit(marker))
            | F.coalesce(F.contains(F.get(strings, i - 1), F.lit(marker)), F.lit(False)),
            redaction(s),
        ).otherwise(s),
    )


@normaliser("files.fb_events", "appstate")
def queued_sdk_events(src: Sources) -> DataFrame:
    files = src.files(r"(^|/)AppEventsLogger\.persistedevents$").withColumn(
        "strings", redact_after_marker(printable_strings("content", 5))
    )
    return files.select(
        "case_id",
        F.lit("facebook_sdk_queued_events").alias("key"),
        F.lit(
            "Java-serialized Facebook SDK event queue (best-effort string inventory); "
            "any access token is redacted"
        ).alias("value"),
        F.array_join("strings", " | ").alias("detail"),
        from_file(0.5),
        F.to_json(F.struct("strings")).alias("raw"),
    )


# Fixed value: key of the cart row.
CART_KEY = "paytm_mall_cart"


@normaliser("appstate.cart", "appstate")
def shopping_cart(src: Sources) -> DataFrame:
    found = json_after(src.files(r"(^|/)common_storage$"), FILE_KEYS, "cartResponse")

    def cart(name: str) -> Column:
        return F.coalesce(json_text("body", f"$.cart.{name}"), F.lit("None"))

    items = F.coalesce(F.json_array_length(json_text("body", "$.cart.cart_items")), F.lit(0))
    date = json_text("body", "$.networkResponse.headers.date")
    return found.select(
        "case_id",
        F.lit(CART_KEY).alias("key"),
        F.concat_ws(
            " ",
            F.concat(F.lit("cart_id="), cart("cart_id")),
            F.concat(F.lit("count="), cart("count")),
            F.concat(F.lit("items="), items.cast("string")),
            F.concat(F.lit("customer_id="), cart("customer_id")),
            F.concat(F.lit("order_total="), cart("order_total")),
        ).alias("value"),
        json_text("body", "$.cart.place_order_url").alias("detail"),
        F.struct(
            date.alias("raw"), F.lit("http_date").alias("epoch_type"), http_date(date).alias("utc")
        ).alias("timestamp"),
        from_file(),
        json_text("body", "$.cart").alias("raw"),
    )


SESSION = r"\.crashlytics\.v3/.+/open-sessions/([^/]+)/(.+)$"


@normaliser("crash.sessions", "crash")
def crash_sessions(src: Sources) -> DataFrame:
    """One row per session folder, put together from its files by name."""
    files = src.files(SESSION).select(
        "*", F.regexp_extract("path", SESSION, 1).alias("session_id"), byte_text("content").alias("t")
    )

    def of(name: str, value: Column) -> Column:
        return F.max_by(value, F.when(F.col("name") == name, F.col("path")))

    text = F.decode("content", "UTF-8")
    anchor = F.struct("path", "sha256")
    rank = F.when(F.col("name") == "user-data", 0).when(F.col("name") == "start-time", 1).otherwise(2)
    sessions = files.groupBy("case_id", "session_id").agg(
        of("user-data", json_text(text, "$.userId")).alias("user_id"),
        of("start-time", F.trim(text)).alias("start"),
        F.coalesce(of("keys", text), of("report", text)).alias("preview"),
        F.min_by(anchor, F.struct(rank.alias("r"), "path")).alias("a"),
    )
    return sessions.select(
        "case_id",
        "session_id",
        "user_id",
        F.when(F.col("start").isNotNull(), decode_epoch("start")).alias("start_time"),
        "preview",
        F.col("a.path").alias("path"),
        F.col("a.sha256").alias("sha256"),
    ).select("*", from_file())


@normaliser("notifications.in_app", "notification")
def in_app_notifications(src: Sources) -> DataFrame:
    """Every JSON object inside the serialized store; a store without any gives its strings."""
    files = src.files(r"(^|/)in_app_notification_model$")
    found = json_objects(files, FILE_KEYS)

    def pick(*names: str) -> Column:
        return F.coalesce(*[present(json_text("body", f"$.{n}")) for n in names])

    decoded = found.select(
        "case_id",
        pick("title", "heading").alias("title"),
        redact_text(F.coalesce(pick("message", "body"), "body")).alias("message"),
        pick("deeplink", "deepLink", "url").alias("deep_link"),
        pick("campaignId").alias("campaign_id"),
        F.lit(False).alias("is_dedup_record"),
        from_file(0.7),
        F.col("body").alias("raw"),
    )
    strings = printable_strings("content", 6)
    silent = files.join(found.select(*FILE_KEYS).distinct(), FILE_KEYS, "left_anti").select(
        "case_id",
        F.lit("(Java-serialized in-app notification store)").alias("title"),
        redact_text(
            F.concat(
                F.lit("best-effort string inventory: "),
                F.array_join(strings, " | "),
            )
        ).alias("message"),
        F.lit(False).alias("is_dedup_record"),
        from_file(0.4),
        F.to_json(F.struct(strings.alias("strings"))).alias("raw"),
    )
    return decoded.unionByName(silent, allowMissingColumns=True)
