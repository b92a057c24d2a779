"""The normalisers of files: pages, documents and events packed into source-shaped blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Tables, query
from .normal import run, text, utc


def blobs(df: DataFrame, path: Column, content: Column, case: Column | None = None) -> DataFrame:
    """Files as the file normalisers read them, all of one case unless told otherwise."""
    body = content.cast("binary")
    return df.select(
        (F.lit("case") if case is None else case).alias("case_id"),
        path.alias("path"),
        F.substring_index(path, "/", -1).alias("name"),
        F.length(body).cast("bigint").alias("size"),
        body.alias("content"),
        F.sha2(body, 256).alias("sha256"),
    )


def path_column(name: str = "path") -> Column:
    return F.col("provenance.source_file").alias(name)


@query(
    "normalise_settings_xml",
    """SELECT 'shared_prefs/f' || event_id || '.xml' AS path, 'user' AS key, 'U' || user_id AS value FROM events
  WHERE event_id % 20 <> 3
UNION ALL SELECT 'shared_prefs/f' || event_id || '.xml', 'count', CAST(event_id AS VARCHAR) FROM events
  WHERE event_id % 20 <> 3
UNION ALL SELECT 'shared_prefs/f' || event_id || '.xml', 'refresh_token', '<redacted:' ||
  length(event_type) || ' chars>' FROM events WHERE event_id % 20 <> 3""",
)
def normalise_settings_xml(t: Tables) -> DataFrame:
    """Key/value XML; every twentieth file is cut off and gives nothing."""
    n = F.col("event_id")
    xml = text(
        '<?xml version="1.0" encoding="utf-8"?>\n<map><string name="user">U', F.col("user_id"),
        '</string><int name="count" value="', n, '" /><string name="refresh_token">',
        F.col("event_type"), "</string></map>",
    )
    whole = F.when(n % 20 == 3, F.left(xml, F.length(xml) - 9)).otherwise(xml)
    files = blobs(t("events"), text("shared_prefs/f", n, ".xml"), whole)
    return run(t, "prefs", files=files).select(path_column(), "key", "value")


@query(
    "normalise_owner",
    """WITH own AS (SELECT * FROM customer WHERE c_custkey % 3 = 1
  QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1)
SELECT 'n' || n_nationkey AS case_id, 'C' || n_nationkey AS customer_id, c_name AS name,
  '9' || c_custkey AS phone, true AS is_subject, 'sb' || c_custkey AS sendbird_id,
  'bank' || c_custkey AS bank_name
FROM nation LEFT JOIN own ON c_nationkey = n_nationkey""",
)
def normalise_owner(t: Tables) -> DataFrame:
    """One owner per case (here: per nation): the first row marked as own, with facts out of the
    settings file."""
    key = F.col("c_custkey")
    users = t("customer").select(
        text("n", F.col("c_nationkey")).alias("case_id"), key.alias("rowid"),
        (key % 3 == 1).cast("int").alias("isMe"), F.col("c_name").alias("sendbirdUserName"),
        text("sb", key).alias("sendbirdUserId"), text("9", key).alias("phoneNumber"),
        text("bank", key).alias("bankName"),
    )
    n = F.col("n_nationkey")
    xml = text('<map><string name="userId">C', n, "</string></map>")
    path = F.lit("shared_prefs/bank_secure_prefs.xml")
    files = blobs(t("nation"), path, xml, text("n", n))
    return run(t, "identity", {"TBL_USERS": users}, files).select(
        "case_id", "customer_id", "name", "phone", "is_subject", "sendbird_id", "bank_name"
    )


@query(
    "normalise_sealed_stores",
    """SELECT 'c' || doc_id || '.json' AS name, 'Vertical JSON cache' AS owning_module,
  length(base64(encode(text))) AS size FROM documents WHERE doc_id % 2 = 0 AND length(base64(encode(text))) >= 66
UNION ALL SELECT 'DataUPI.xml', 'NPCI UPI security component', 11 + length(s_suppkey::VARCHAR) FROM supplier""",
)
def normalise_sealed_stores(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n]", "")
    body = F.when(n % 2 == 0, coded).otherwise(text('{"a":"', coded, '"}'))
    caches = blobs(t("documents"), text("shared_jsons/c", n, ".json"), body)
    s = F.col("s_suppkey")
    path = text("d", s, "/DataUPI.xml")
    sealed = blobs(t("supplier"), path, text("<map>", s, "</map>"), text("case", s))
    return run(t, "encrypted.catalogue", files=caches.unionByName(sealed)).select(
        "name", "owning_module", "size"
    )


def response(t: Tables) -> DataFrame:
    n = F.col("page_id")
    body = text(
        "\x00\x01", '{"userId":', n, ',"method":"GET","created":', 1_700_000_000_000 + n * 1000,
        ',"note":"token=', F.sha2(n.cast("string"), 256), '"}\x00', F.col("url"), "\x00",
    )
    content = F.when(n % 4 == 0, F.col("html")).otherwise(body)
    return blobs(t("pages"), text("app_webview/Service Worker/CacheStorage/", n, "_0"), content)


@query(
    "normalise_web_cache",
    """SELECT url, 'GET' AS method, CAST(page_id AS VARCHAR) AS user_id,
  '{"userId": ' || page_id || ', "method": "GET", "created": ' || (1700000000000 + page_id * 1000) ||
    ', "note": "token=<redacted:64 chars>"}' AS body_preview,
  make_timestamp((1700000000 + page_id) * 1000000) AS utc FROM pages WHERE page_id % 4 <> 0""",
)
def normalise_web_cache(t: Tables) -> DataFrame:
    return run(t, "webview.cache", files=response(t)).select(
        "url", "method", "user_id", "body_preview", utc("created")
    )


@query(
    "normalise_local_storage",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || repeat('o', 130 * (page_id % 2)) AS origin,
  repeat('k', 150 * (page_id % 3)) AS long_key, repeat('v', 500 * (page_id % 5)) AS long_value FROM pages)
SELECT origin, 'key' || page_id || long_key AS key, 'value-' || page_id || long_value AS value,
  CASE WHEN page_id % 2 = 0 THEN 'session_storage' ELSE 'local_storage' END AS store_kind FROM p
UNION ALL SELECT origin, 'last', NULL, CASE WHEN page_id % 2 = 0 THEN 'session_storage'
  ELSE 'local_storage' END FROM p""",
)
def normalise_local_storage(t: Tables) -> DataFrame:
    """Two keys per file, the first one repeated with another value and the last one without any; origins, keys
    and values of some files are long."""
    n = F.col("page_id")
    origin = F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.expr("repeat('o', cast(130 * (page_id % 2) AS int))"))
    lead = F.concat(F.lit("_"), origin, F.lit("\x00\x01"))
    key = text("key", n, F.expr("repeat('k', cast(150 * (page_id % 3) AS int))"))
    value = text("value-", n, F.expr("repeat('v', cast(500 * (page_id % 5) AS int))"))
    body = text(lead, key, "\x02", value, "\x00", lead, key, "\x00later\x00", lead, "last\x00ab\x01")
    folder = F.when(n % 2 == 0, "Session Storage").otherwise("Local Storage/leveldb")
    files = blobs(t("pages"), text("app_webview/", folder, "/", n, ".log"), body)
    return run(t, "webview.localstorage", files=files).select("origin", "key", "value", "store_kind")


@query(
    "normalise_indexed_db",
    """SELECT 'https://host' || page_id AS origin, page_id || '.ldb' AS key, url AS value FROM pages
UNION ALL SELECT 'https://host' || page_id, page_id || '.ldb', 'stored value ' || page_id FROM pages""",
)
def normalise_indexed_db(t: Tables) -> DataFrame:
    n = F.col("page_id")
    body = text("\x00", F.col("url"), "\x00short\x00stored value ", n, "\x01", F.col("url"), "\x02")
    path = text("app_webview/IndexedDB/https_host", n, "_0.indexeddb.leveldb/", n, ".ldb")
    files = blobs(t("pages"), path, body)
    return run(t, "webview.indexeddb", files=files).select("origin", "key", "value")


@query(
    "normalise_datastore",
    """SELECT doc_id || '.preferences_pb' AS key, CASE WHEN doc_id % 3 = 0 THEN '(empty)'
    ELSE 'theme' || doc_id || ' | ' || source || ' name' END AS value FROM documents""",
)
def normalise_datastore(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    body = F.when(n % 3 == 0, "\x01\x02abc\x00").otherwise(
        text("\x0a\x05theme", n, "\x12\x00", F.col("source"), " name\x00abc")
    )
    files = blobs(t("documents"), text("files/datastore/", n, ".preferences_pb"), body)
    return run(t, "files.datastore", files=files).select("key", "value")


@query(
    "normalise_installation_ids",
    """SELECT 'Fid' AS key, 'f' || c_custkey AS value, 'PersistedInstallation.' || c_custkey || '.json' AS pref_file
FROM customer WHERE c_custkey % 9 <> 0
UNION ALL SELECT 'AuthToken', '<redacted:' || length(c_name) || ' chars>',
  'PersistedInstallation.' || c_custkey || '.json' FROM customer WHERE c_custkey % 9 <> 0""",
)
def normalise_installation_ids(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    good = text('{"Fid":"f', n, '","AuthToken":"', F.col("c_name"), '"}')
    body = F.when(n % 9 == 0, "[broken").otherwise(good)
    files = blobs(t("customer"), text("files/PersistedInstallation.", n, ".json"), body)
    return run(t, "files.firebase_installation", files=files).select("key", "value", "pref_file")


def remote_files(t: Tables) -> DataFrame:
    n = F.col("p_partkey")
    flags = text('{"configs_key":{"autopay_', n, '":"', (n % 2 == 0).cast("string"), '","colour":"', F.col("p_size"), '"}}')
    flat = text('{"limit_', n, '":', F.col("p_size"), ',"nested":{"a":1}}')
    body = F.when(n % 5 == 0, flat).otherwise(flags)
    return blobs(t("part"), text("files/frc_", n, "_firebase_activate.json"), body)


@query(
    "normalise_remote_config",
    """SELECT 'autopay_' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS value,
  'Feature flag (on/off)' AS kind FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'colour', CAST(p_size AS VARCHAR), 'Numeric setting' FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'limit_' || p_partkey, CAST(p_size AS VARCHAR), 'Threshold / limit' FROM part
WHERE p_partkey % 5 = 0""",
)
def normalise_remote_config(t: Tables) -> DataFrame:
    return run(t, "files.remote_config", files=remote_files(t)).select("key", "value", "kind")


@query(
    "normalise_capabilities",
    """SELECT 'Feature flag (remote config)' AS category, 'autopay_' || p_partkey AS name,
  CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS value, p_partkey % 2 = 0 AS available
FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'Server API endpoint', 'e' || s_suppkey, 'https://x/' || s_suppkey, true FROM supplier
UNION ALL SELECT 'Payment instrument', s_name, 'w', s_suppkey % 2 = 0 FROM supplier""",
)
def normalise_capabilities(t: Tables) -> DataFrame:
    n = F.col("s_suppkey")
    doc = text(
        '{"apiUrlsInfo":{"e', n, '":"https://x/', n, '"},"filters":[{"requestParam":"paymentSystem","values":[',
        '{"displayName":"', F.col("s_name"), '","isActive":', (n % 2 == 0).cast("string"),
        ',"requestParamValue":"w"}]},{"requestParam":"other","values":[{"displayName":"z"}]}]}',
    )
    filters = blobs(t("supplier"), text("u", n, "/uthSearchFilterMetaData1.json"), doc)
    files = filters.unionByName(remote_files(t))
    return run(t, "capabilities", files=files).select("category", "name", "value", "available")


@query(
    "normalise_sdk_events",
    """SELECT 'header | <redacted:17 chars> | <redacted:' || length(text) || ' chars> | tail ' || conv_id AS detail
FROM (SELECT conv_id, 'EAA' || conv_id || '-' || turn AS text FROM conversations)""",
)
def normalise_sdk_events(t: Tables) -> DataFrame:
    """The string at the token marker and the one right after it are cut to their lengths."""
    c, n = F.col("conv_id"), F.col("turn")
    body = text("\x00header\x00accessTokenString\x00EAA", c, "-", n, "\x00tail ", c, "\x00")
    files = blobs(t("conversations"), text("files/", c, "-", n, "/AppEventsLogger.persistedevents"), body)
    return run(t, "files.fb_events", files=files).select("detail")


@query(
    "normalise_cart",
    """SELECT 'cart_id=' || o_orderkey || ' count=' || (o_orderkey % 3) || ' items=' || (o_orderkey % 3) ||
    ' customer_id=' || o_custkey || ' order_total=None' AS value,
  'https://order/' || o_orderkey AS detail, o_orderdate AS utc FROM orders WHERE o_orderkey % 10 <> 0""",
)
def normalise_cart(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    items = F.array_join(F.array_repeat(F.lit("1"), (n % 3).cast("int")), ",")
    date = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss")
    body = text(
        "\x02{x cartResponse\x00", '{"cart":{"cart_id":', n, ',"count":', n % 3, ',"cart_items":[', items,
        '],"customer_id":', F.col("o_custkey"), ',"place_order_url":"https://order/', n,
        '"},"networkResponse":{"headers":{"date":"', date, ' GMT"}}}\x00',
    )
    body = F.when(n % 10 != 0, body).otherwise("no document here")
    files = blobs(t("orders"), text("app_data/", n, "/common_storage"), body)
    return run(t, "appstate.cart", files=files).select("value", "detail", utc())


@query(
    "normalise_crash_sessions",
    """SELECT 'S' || event_id AS session_id, CASE WHEN event_id % 3 <> 0 THEN 'U' || user_id END AS user_id,
  CASE WHEN event_id % 2 = 0 THEN 'keys of ' || event_type ELSE 'report of ' || event_type END AS preview,
  date_trunc('millisecond', ts) AS utc FROM events""",
)
def normalise_crash_sessions(t: Tables) -> DataFrame:
    """Three files per session folder, put together again by the session id in their path."""
    n = F.col("event_id")
    kinds = F.array(
        F.struct(
            F.lit("user-data").alias("file"),
            F.when(n % 3 != 0, text('{"userId":"U', F.col("user_id"), '"}')).otherwise("{bad").alias("body"),
        ),
        F.struct(
            F.lit("start-time").alias("file"),
            text(" ", F.unix_millis(F.col("ts").cast("timestamp")), " ").alias("body"),
        ),
        F.struct(
            F.when(n % 2 == 0, "keys").otherwise("report").alias("file"),
            text(
                F.when(n % 2 == 0, "keys of ").otherwise("report of "), F.col("event_type")
            ).alias("body"),
        ),
    )
    parts = t("events").select(n, F.explode(kinds).alias("k"))
    path = text("files/.crashlytics.v3/app/open-sessions/S", n, "/", F.col("k.file"))
    files = blobs(parts, path, F.col("k.body"))
    return run(t, "crash.sessions", files=files).select(
        "session_id", "user_id", "preview", utc("start_time")
    )


@query(
    "normalise_in_app_notifications",
    """SELECT 'T' || page_id AS title, 'body ' || page_id AS message, url AS deep_link FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT 'H' || page_id, '{"heading": "H' || page_id || '"}', NULL FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT '(Java-serialized in-app notification store)',
  'best-effort string inventory: serialized ' || page_id || ' | second string', NULL FROM pages WHERE page_id % 3 = 0""",
)
def normalise_in_app_notifications(t: Tables) -> DataFrame:
    n = F.col("page_id")
    packed = text(
        "\x01{", '{"title":"T', n, '","body":"body ', n, '","deepLink":"', F.col("url"), '"}\x00{}',
        '{"heading":"H', n, '"}\x00',
    )
    silent = text("\x00serialized ", n, "\x00second string\x01abc")
    body = F.when(n % 3 == 0, silent).otherwise(packed)
    files = blobs(t("pages"), text("files/", n, "/in_app_notification_model"), body)
    return run(t, "notifications.in_app", files=files).select("title", "message", "deep_link")


@query(
    "file_kinds",
    """WITH paths AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'databases/passbook.db'
    WHEN 1 THEN 'shared_prefs/a.XML' WHEN 2 THEN 'shared_jsons/b.json' WHEN 3 THEN 'x/Local Storage/leveldb/1.ldb'
    WHEN 4 THEN 'files/datastore/c' WHEN 5 THEN 'app/Cookies' WHEN 6 THEN 'databases/passbook.db-shm'
    ELSE source || '/other' END AS path FROM documents)
SELECT path, CASE min(doc_id % 8) WHEN 0 THEN 'sqlite' WHEN 1 THEN 'prefs_xml' WHEN 2 THEN 'json_cache'
    WHEN 3 THEN 'leveldb' WHEN 4 THEN 'datastore' WHEN 5 THEN 'sqlite' ELSE 'other' END AS kind, count(*) AS n
FROM paths WHERE doc_id % 8 <> 6 GROUP BY 1""",
)
def file_kinds(t: Tables) -> DataFrame:
    from ...sources.files import artifacts

    options = F.array(*[F.lit(p) for p in (
        "databases/passbook.db", "shared_prefs/a.XML", "shared_jsons/b.json",
        "x/Local Storage/leveldb/1.ldb", "files/datastore/c", "app/Cookies", "databases/passbook.db-shm",
    )])
    pick = F.get(options, (F.col("doc_id") % 8).cast("int"))
    path = F.coalesce(pick, F.concat("source", F.lit("/other")))
    inventory = t("documents").select(
        path.alias("path"), F.substring_index(path, "/", -1).alias("name")
    )
    return artifacts(inventory).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_file_by_name",
    """SELECT 'case' || (doc_id % 5) AS case_id, source || '.db' AS name,
  min('d' || lpad(doc_id::VARCHAR, 9, '0') || '/' || source || '.db') AS path FROM documents GROUP BY ALL""",
)
def first_file_by_name(t: Tables) -> DataFrame:
    from ...sources.files import first_by_name

    name = F.concat("source", F.lit(".db"))
    files = t("documents").select(
        text("case", F.col("doc_id") % 5).alias("case_id"),
        F.lit("root").alias("root"),
        text("d", F.lpad(F.col("doc_id").cast("string"), 9, "0"), "/", name).alias("path"),
        name.alias("name"),
        F.col("n_chars").alias("size"),
        F.lit("other").alias("kind"),
    )
    return first_by_name(files).select("case_id", "name", "path")


@query(
    "export_csv_frame",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS tag,
  '["a","' || o_orderkey || '"]' AS vpas, 'b.db' AS "prov.source_file", '' AS "prov.source_table",
  CAST(o_orderkey AS VARCHAR) AS "prov.rowid", 'live' AS "prov.origin",
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS "timestamp.utc_iso", 'unix_ms' AS "timestamp.epoch_type"
FROM orders""",
)
def export_csv_frame(t: Tables) -> DataFrame:
    """The flat text columns a CSV export writes."""
    from ...schemas import provenance
    from ...sources.sinks import csv_frame
    from .timelines import stamp

    n = F.col("o_orderkey")
    rows = t("orders").select(
        n.alias("id"), F.when(n % 3 != 0, F.col("o_orderpriority")).alias("tag"),
        F.array(F.lit("a"), n.cast("string")).alias("vpas"), stamp("o_orderdate"),
        provenance("b.db", None, n).alias("provenance"), F.lit("{}").alias("raw"),
    )
    wanted = ["id", "tag", "vpas", "prov.source_file", "prov.source_table", "prov.rowid", "prov.origin",
              "timestamp.utc_iso", "timestamp.epoch_type"]
    return csv_frame(rows).select(*[f"`{c}`" for c in wanted])


@query(
    "display_cells",
    """SELECT CAST(o_totalprice AS VARCHAR) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS tag,
  strftime(o_orderdate, '%d %b %Y, %H:%M:%S') AS timestamp, CAST(o_orderstatus = 'F' AS VARCHAR) AS settled,
  'C' || repeat('•', length(CAST(o_custkey AS VARCHAR))) AS counterparty_name FROM orders""",
)
def display_cells(t: Tables) -> DataFrame:
    """Display columns of a domain as text, names masked on demand."""
    from ...operators.records import display_frame
    from .timelines import stamp

    n = F.col("o_orderkey")
    rows = t("orders").select(
        F.col("o_totalprice").alias("amount"), F.when(n % 3 != 0, F.col("o_orderpriority")).alias("tag"),
        stamp("o_orderdate"), (F.col("o_orderstatus") == "F").alias("settled"),
        text("C", F.col("o_custkey")).alias("counterparty_name"), n.alias("not_shown"),
    )
    return display_frame("transaction", rows, masked=True)
