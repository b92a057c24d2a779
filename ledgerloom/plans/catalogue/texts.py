"""Queries over free text, pages, settings and embedded JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import configtext, masks, parties, secrets
from ...functions.clocks import http_date, shift_hours
from ...functions.text import (
    in_document,
    json_text,
    nested_json_text,
    short_class,
    to_bigint,
    to_double,
    truncate,
    with_document,
)
from ...operators import masking, quality, records
from ...operators.residual import harvest, residual_identifiers
from ...operators.skew import scan_in_order
from ...session import spread
from ...sources.embedded import json_objects, json_responses
from ...sources.files import string_inventory
from .base import Tables, query, sql_rejoin, sql_words

# ---- settings and JSON columns -----------------------------------------------------------------

KEYS = (
    "GoldP2PMaxAmount",
    "kyc_otp_timeout_ios",
    "newRolloutFlag",
    "walletH5Url_android",
    "txnListCacheTtl",
    "plainSetting",
)


def _pick(options, n) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


SQL_KEYS = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"


@query(
    "config_explain",
    f"""WITH kv AS (SELECT event_id, ({SQL_KEYS})[event_id % 6 + 1] || CASE WHEN event_id % 12 >= 6
    THEN CAST(user_id AS VARCHAR) ELSE '' END AS key,
    CASE event_id % 5 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN 'True'
      WHEN 2 THEN 'https://x.example/' || event_id WHEN 3 THEN props ELSE event_type END AS value
  FROM events),
low AS (SELECT *, lower(key) AS lk, regexp_replace(regexp_replace(replace(
    regexp_replace(key, '_(ios|android)$', '', 'i'), '_', ' '),
    '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g') AS spaced FROM kv)
SELECT event_id, key,
  CASE WHEN value LIKE 'https://%' THEN 'API endpoint / URL'
    WHEN value = 'True' THEN 'Feature flag (on/off)'
    WHEN contains(lk, 'rollout') THEN 'Experiment / rollout %'
    WHEN value LIKE '{{%' THEN 'Structured config (JSON)'
    WHEN regexp_full_match(value, '[0-9]+') AND regexp_matches(lk, 'max|amount|timeout|ttl')
      THEN 'Threshold / limit'
    WHEN regexp_full_match(value, '[0-9]+') THEN 'Numeric setting'
    ELSE 'Setting / value' END AS kind,
  CASE WHEN key = 'GoldP2PMaxAmount' THEN 'Maximum amount allowed for a Gold peer-to-peer transfer'
    ELSE '≈ ' || array_to_string(list_transform(list_filter(string_split(spaced, ' '),
      lambda w: w <> ''), lambda w: CASE lower(w) WHEN 'kyc' THEN 'KYC' WHEN 'otp' THEN 'OTP'
      WHEN 'max' THEN 'maximum' WHEN 'url' THEN 'URL' WHEN 'txn' THEN 'transaction'
      WHEN 'ttl' THEN 'cache lifetime' WHEN 'ios' THEN 'iOS' WHEN 'android' THEN 'Android' ELSE w END), ' ') END AS meaning
FROM low""",
)
def config_explain(t: Tables) -> DataFrame:
    n = F.col("event_id")
    key = F.concat(_pick(KEYS, n), F.when(n % 12 >= 6, F.col("user_id").cast("string")).otherwise(""))
    value = (
        F.when(n % 5 == 0, json_text("props", "$.k"))
        .when(n % 5 == 1, "True")
        .when(n % 5 == 2, F.concat(F.lit("https://x.example/"), n))
        .when(n % 5 == 3, F.col("props"))
        .otherwise(F.col("event_type"))
    )
    kv = t("events").select("event_id", key.alias("key"), value.alias("value"))
    return kv.select(
        "event_id",
        "key",
        configtext.config_kind("key", "value").alias("kind"),
        configtext.config_meaning("key").alias("meaning"),
    )


@query(
    "json_column_extract",
    """WITH docs AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props || '}x'
    WHEN 1 THEN '{"amount":"' || value || '","deep":{"k":' || user_id || '}}'
    WHEN 2 THEN '{"amount":"12d"}' WHEN 3 THEN 'not json' ELSE props END AS doc, props, value FROM events)
SELECT event_id, CASE event_id % 5 WHEN 1 THEN value END AS amount,
  CASE event_id % 5 WHEN 4 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE event_id % 5 WHEN 1 THEN json_extract_string(doc, '$.deep.k') END AS deep
FROM docs""",
)
def json_column_extract(t: Tables) -> DataFrame:
    n = F.col("event_id") % 5
    doc = (
        F.when(n == 0, F.concat("props", F.lit("}x")))
        .when(
            n == 1,
            F.concat(
                F.lit('{"amount":"'), "value", F.lit('","deep":{"k":'), "user_id", F.lit("}}")
            ),
        )
        .when(n == 2, '{"amount":"12d"}')
        .when(n == 3, "not json")
        .otherwise(F.col("props"))
    )
    rows = t("events").select("event_id", doc.alias("doc"))
    whole = with_document(rows, "doc", "parsed")
    return whole.select(
        "event_id",
        to_double(in_document("parsed", ".amount")).alias("amount"),
        to_bigint(in_document("parsed", ".k")).alias("k"),
        in_document("parsed", ".deep.k").alias("deep"),
    )


@query(
    "text_functions",
    """SELECT o_orderkey, o_orderdate + INTERVAL 330 MINUTE AS local_time,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS header_time,
  'Bank ' || (o_custkey % 9) AS instrument, 'Worker' || (o_custkey % 5) AS short_name,
  left(o_orderpriority || ' ' || o_orderkey, 8) AS cut,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'since ' || o_custkey END AS account_age
FROM orders""",
)
def text_functions(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    header = F.when(
        n % 4 != 0, F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    ).otherwise("yesterday")
    head = F.concat(
        F.lit('[{"instrumentName":"Bank '), F.col("o_custkey") % 9, F.lit('"},{"instrumentName":"x"}]')
    )
    age = F.to_json(
        F.struct(
            F.when(
                n % 3 != 0,
                F.to_json(
                    F.struct(F.concat(F.lit("since "), "o_custkey").alias("customerCreationText"))
                ),
            ).otherwise("broken{").alias("jsonString")
        )
    )
    ntz = "timestamp_ntz"
    return t("orders").select(
        "o_orderkey",
        shift_hours(F.col("o_orderdate").cast("timestamp"), 5.5).cast(ntz).alias("local_time"),
        http_date(header).cast(ntz).alias("header_time"),
        json_text(head, "$[0].instrumentName").alias("instrument"),
        short_class(F.concat(F.lit("com.acme.jobs.Worker"), F.col("o_custkey") % 5)).alias(
            "short_name"
        ),
        truncate(F.concat_ws(" ", "o_orderpriority", n.cast("string")), 8).alias("cut"),
        nested_json_text(age, "$.jsonString", "$.customerCreationText").alias("account_age"),
    )


# ---- identifiers -------------------------------------------------------------------------------


def token_lists(t: Tables) -> DataFrame:
    """Comma lists as the ledger keeps them: names, sometimes a mobile, usually a reference last."""
    n = F.col("o_orderkey")
    mobile = F.when(n % 3 == 0, (F.col("o_custkey") + 9_000_000_000).cast("string")).otherwise("shop")
    ref = F.lpad(n.cast("string"), 12, "4")
    last = F.when(n % 5 == 0, F.concat(ref, F.lit(", end"))).otherwise(ref)
    return t("orders").select(
        "o_orderkey",
        F.when(n % 31 != 0, F.concat_ws(",", "o_orderpriority", mobile, last)).alias("tokens"),
    )


SQL_TOKENS = """lists AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority || ',' ||
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey + 9000000000 AS VARCHAR) ELSE 'shop' END || ',' ||
    lpad(CAST(o_orderkey AS VARCHAR), 12, '4') || CASE WHEN o_orderkey % 5 = 0 THEN ', end' ELSE '' END
  END AS tokens FROM orders),
cut AS (SELECT *, list_transform(string_split(tokens, ','), lambda x: trim(x)) AS parts FROM lists)"""


@query(
    "token_extract",
    f"""WITH {SQL_TOKENS}
SELECT o_orderkey, CASE WHEN regexp_full_match(parts[-1], '[0-9]{{12}}') THEN parts[-1] END AS rrn,
  list_filter(parts, lambda x: regexp_full_match(x, '[6-9][0-9]{{9}}'))[1] AS mobile FROM cut""",
)
def token_extract(t: Tables) -> DataFrame:
    return token_lists(t).select(
        "o_orderkey",
        parties.last_token_rrn("tokens").alias("rrn"),
        parties.first_token_mobile("tokens").alias("mobile"),
    )


@query(
    "token_positions",
    f"""WITH {SQL_TOKENS}, seen AS (SELECT *, regexp_full_match(parts[-1], '[0-9]{{12}}') AS last_hit,
    len(list_filter(parts, lambda x: regexp_full_match(x, '[0-9]{{12}}'))) > 0 AS any_hit
  FROM cut WHERE tokens IS NOT NULL)
SELECT count(*) AS n_lists, count(*) FILTER (last_hit) AS n_last,
  count(*) FILTER (any_hit AND NOT last_hit) AS n_elsewhere, count(*) FILTER (NOT any_hit) AS n_none,
  count(*) FILTER (len(list_filter(parts, lambda x: regexp_full_match(x, '[6-9][0-9]{{9}}'))) > 0)
    AS n_with_mobile
FROM seen""",
)
def token_positions(t: Tables) -> DataFrame:
    return quality.token_positions(token_lists(t), "tokens")


def narrations(t: Tables) -> DataFrame:
    """Prose with identifiers in it, made from orders."""
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    return spread(t("orders").select("o_orderkey", "o_custkey")).select(
        F.lit("case").alias("case_id"),
        F.col("o_orderkey"),
        F.concat(
            F.lit("Paid "), (9_100_000_000 + c).cast("string"), F.lit(" via u"), c,
            F.when(n % 2 == 0, "@okaxis").otherwise("@ybl"),
            F.lit(" ref "), F.lpad(n.cast("string"), 12, "7"),
            F.when(n % 4 == 0, F.concat(F.lit(" UPI"), F.lpad(n.cast("string"), 9, "A"))).otherwise(""),
            F.when(n % 5 == 0, F.concat(F.lit(" at 12.34567, 7"), n % 10, F.lit(".54321"))).otherwise(""),
            F.when(n % 6 == 0, F.concat(F.lit(' {"payee_name":"Shop '), c, F.lit('"}'))).otherwise(""),
            F.when(n % 7 == 0, F.concat(F.lit(" IFSC HDFC0"), F.lpad(c.cast("string"), 6, "0"))).otherwise(""),
            F.when(n % 9 == 0, F.concat(F.lit(" mail a.b"), c, F.lit("@mail.example.com"))).otherwise(""),
        ).alias("text"),
    )


SQL_NARRATIONS = """narrations AS (SELECT o_orderkey, o_custkey, 'Paid ' || (9100000000 + o_custkey) || ' via u' || o_custkey ||
    CASE WHEN o_orderkey % 2 = 0 THEN '@okaxis' ELSE '@ybl' END ||
    ' ref ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '7') ||
    CASE WHEN o_orderkey % 4 = 0 THEN ' UPI' || lpad(CAST(o_orderkey AS VARCHAR), 9, 'A') ELSE '' END ||
    CASE WHEN o_orderkey % 5 = 0 THEN ' at 12.34567, 7' || (o_orderkey % 10) || '.54321' ELSE '' END ||
    CASE WHEN o_orderkey % 6 = 0 THEN ' {"payee_name":"Shop ' || o_custkey || '"}' ELSE '' END ||
    CASE WHEN o_orderkey % 7 = 0 THEN ' IFSC HDFC0' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE '' END ||
    CASE WHEN o_orderkey % 9 = 0 THEN ' mail a.b' || o_custkey || '@mail.example.com' ELSE '' END
    AS text FROM orders)"""


@query(
    "identifier_harvest",
    f"""WITH {SQL_NARRATIONS}, found AS (
  SELECT o_orderkey, 'vpa' AS kind, unnest(list_distinct(regexp_extract_all(text,
    '[a-zA-Z0-9._-]{{2,40}}@[a-zA-Z]{{3,15}}'))) AS value FROM narrations
  UNION ALL SELECT o_orderkey, 'rrn', unnest(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'),
    lambda x: length(x) = 12))) FROM narrations
  UNION ALL SELECT o_orderkey, 'phone', unnest(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'),
    lambda x: regexp_full_match(x, '[6-9][0-9]{{9}}')))) FROM narrations
  UNION ALL SELECT o_orderkey, 'txn_id', unnest(list_distinct(regexp_extract_all(text,
    '(?:PYTM|PTM|AXI|HDF|UPI|ICI|SBI)[A-Za-z0-9]{{8,40}}'))) FROM narrations)
SELECT o_orderkey, kind, value, CAST(instr(text, value) - 1 AS BIGINT) AS byte_offset
FROM found JOIN narrations USING (o_orderkey)
WHERE NOT (kind = 'phone' AND value IN (SELECT CAST(9100000000 + c_custkey AS VARCHAR) FROM customer
    WHERE c_custkey % 2 = 0))
  AND NOT (kind = 'vpa' AND value IN (SELECT 'u' || c_custkey || '@ybl' FROM customer))""",
)
def identifier_harvest(t: Tables) -> DataFrame:
    """Identifiers in text minus the ones live records carry."""
    key = F.col("c_custkey")
    case = F.lit("case").alias("case_id")
    phones = t("customer").where(key % 2 == 0).select(
        case, F.lit("phone").alias("kind"), (9_100_000_000 + key).cast("string").alias("value")
    )
    handles = t("customer").select(
        case, F.lit("vpa").alias("kind"), F.concat(F.lit("u"), key, F.lit("@ybl")).alias("value")
    )
    live = phones.unionByName(handles).distinct()
    found = residual_identifiers(harvest(narrations(t), ["case_id", "o_orderkey"], "text"), live)
    return found.select("o_orderkey", "kind", "value", "byte_offset")


# ---- pages -------------------------------------------------------------------------------------


@query(
    "string_inventory",
    r"""WITH found AS (SELECT page_id, regexp_extract_all(html, '[\x20-\x7e]{5,}') AS r FROM pages),
runs AS (SELECT page_id, trim(unnest(r)) AS value, unnest(range(len(r))) AS i FROM found),
firsts AS (SELECT page_id, value, min(i) AS i FROM runs WHERE length(value) >= 8 GROUP BY 1, 2)
SELECT page_id, value, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM firsts""",
)
def inventory_of_strings(t: Tables) -> DataFrame:
    """Distinct printable strings per page."""
    files = t("pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return string_inventory(files, ["page_id"], 5, 8)


@query(
    "url_origin_extract",
    """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  regexp_extract(url, '^(https?://[^/]+)', 1) AS origin,
  'https://' || regexp_extract(url, '^https?://([^/]+)', 1) AS stored_origin FROM pages""",
)
def url_origin_extract(t: Tables) -> DataFrame:
    from ..normalisers.webfiles import path_origin

    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    folder = F.concat(F.lit("IndexedDB/https_"), host, F.lit("_0.indexeddb.leveldb/1.log"))
    return t("pages").select(
        "page_id",
        host.alias("host"),
        F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("origin"),
        path_origin(folder).alias("stored_origin"),
    )


def cached_responses(t: Tables) -> DataFrame:
    """Pages as cached responses: two thirds are wrapped into a JSON body with trailing bytes."""
    wrapped = F.concat(
        F.lit("HTTP\x00"),
        F.to_json(F.struct(F.col("page_id").alias("userId"), F.length("html").alias("n"))),
        F.lit("\x01\x02 "),
        "url",
    )
    body = F.when(F.col("page_id") % 3 != 0, wrapped).otherwise(F.col("html"))
    return t("pages").select("page_id", body.cast("binary").alias("content"))


@query(
    "json_bodied_responses",
    """SELECT page_id, CAST(page_id AS VARCHAR) AS user_id, url FROM pages WHERE page_id % 3 <> 0""",
)
def json_bodied_responses(t: Tables) -> DataFrame:
    found = json_responses(cached_responses(t), ["page_id"])
    return found.select("page_id", json_text("body", "$.userId").alias("user_id"), "url")


@query(
    "embedded_objects",
    """SELECT page_id, 0 AS pos, CAST(page_id AS VARCHAR) AS n FROM pages
UNION ALL SELECT page_id, 1, url FROM pages""",
)
def embedded_objects(t: Tables) -> DataFrame:
    """Every JSON object inside mixed content; a broken one in between is passed over."""
    content = F.concat(
        F.lit("\xac{bad "), F.to_json(F.struct(F.col("page_id").alias("n"))), F.lit("\x00{}"),
        F.to_json(F.struct(F.col("url").alias("n"))), F.lit("{"),
    )
    files = t("pages").select("page_id", content.cast("binary").alias("content"))
    return json_objects(files, ["page_id"]).select("page_id", "pos", json_text("body", "$.n").alias("n"))


# ---- masking -----------------------------------------------------------------------------------

SQL_EMAIL = r"[\p{L}\p{N}_][\p{L}\p{N}_.+\-]*@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.]+[\p{L}\p{N}_]"
SQL_HANDLE = r"\b[A-Za-z0-9._\-]{2,}@[A-Za-z]{2,20}\b"
SQL_PAIR = r"-?[0-9]{1,3}\.[0-9]{3,}\s*,\s*-?[0-9]{1,3}\.[0-9]{3,}"
SQL_NAME = r'"payee_name":"[^",}]{2,80}'


def sql_mask_text(x: str, names: str | None = None) -> str:
    """The masking steps one by one as CTEs over rows (id, text)."""
    email = sql_rejoin("s", SQL_EMAIL, "repeat('•', length(m))")
    named = sql_rejoin("s", SQL_NAME, "left(m, 14) || " + sql_words("substr(m, 15)"))
    handle = sql_rejoin(
        "s", SQL_HANDLE,
        "repeat('•', instr(m, '@') - 1) || '@' || repeat('•', length(m) - instr(m, '@'))",
    )
    runs = sql_rejoin(
        "s", "[A-Z0-9]+",
        "CASE WHEN regexp_full_match(m, '[A-Z]{4}0[A-Z0-9]{6}') THEN '••••0••••••' ELSE m END",
    )
    digits = sql_rejoin(
        "s", "[0-9]+", "CASE WHEN length(m) BETWEEN 10 AND 19 THEN repeat('•', length(m)) ELSE m END"
    )
    blur = "printf('%.1f', CAST(trim(x) AS DOUBLE)) || '••••'"
    pair = sql_rejoin(
        "s", SQL_PAIR,
        f"array_to_string(list_transform(string_split(m, ','), lambda x: {blur}), ',')",
    )
    replaced = names or "s"
    return f"""m1 AS (SELECT id, {email} AS s FROM (SELECT id, {x} AS s FROM src)),
m2 AS (SELECT id, {named} AS s FROM m1),
m3 AS (SELECT id, {replaced} AS s FROM m2),
m4 AS (SELECT id, {handle} AS s FROM m3),
m5 AS (SELECT id, {runs} AS s FROM m4),
m6 AS (SELECT id, {digits} AS s FROM m5),
masked AS (SELECT id, {pair} AS s FROM m6)"""


NAME_FOLD = (
    "list_reduce((SELECT list(name ORDER BY length(name) DESC, name) FROM names), "
    f"lambda acc, n: replace(acc, n, {sql_words('n')}), s)"
)


@query(
    "mask_documents",
    f"""WITH names AS (SELECT DISTINCT regexp_extract(text, '^[^ ]+ [^ ]+') AS name FROM benchmark
  WHERE length(regexp_extract(text, '^[^ ]+ [^ ]+')) > 2),
src AS (SELECT doc_id AS id, text FROM documents), {sql_mask_text('text', NAME_FOLD)}
SELECT id AS doc_id, md5(s) AS masked_md5, length(s) AS n_chars,
  length(s) - length(replace(s, '•', '')) AS n_bullets FROM masked""",
)
def mask_documents(t: Tables) -> DataFrame:
    """Whole documents, with the opening words of every benchmark passage as the known names."""
    name = F.regexp_extract("text", "^[^ ]+ [^ ]+", 0).alias("name")
    names = t("benchmark").select(name).where(F.length("name") > 2).distinct()
    texts = spread(t("documents").select("doc_id", "text"))
    out = masking.mask_texts(texts, "doc_id", "text", names)
    return out.select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("masked_md5"),
        F.length("text").cast("bigint").alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit("•"), F.lit("")))).cast("bigint").alias(
            "n_bullets"
        ),
    )


@query(
    "mask_narrations",
    f"""WITH {SQL_NARRATIONS}, src AS (SELECT o_orderkey AS id, text FROM narrations), {sql_mask_text('text')}
SELECT id AS o_orderkey, s AS masked FROM masked""",
)
def mask_narrations(t: Tables) -> DataFrame:
    return narrations(t).select("o_orderkey", masks.mask_text("text").alias("masked"))


@query(
    "mask_record_fields",
    f"""SELECT 'customer' AS source, c_custkey AS id, {sql_words("c_name || ' Foods'")} AS name,
  repeat('•', 10) AS phone,
  repeat('•', length('u' || c_custkey)) || '@•••••' AS vpa, round((c_acctbal + 2000) / 100.0, 1) AS latitude,
  {sql_words("'C' || c_custkey")} || ',' || repeat('•', length(CAST(c_custkey AS VARCHAR))) AS customer_ids,
  c_acctbal AS amount FROM customer
UNION ALL SELECT 'supplier', s_suppkey, {sql_words('s_name')}, NULL, '', NULL, '', s_acctbal FROM supplier""",
)
def mask_record_fields(t: Tables) -> DataFrame:
    """Per-column rules: words, digits, handles, coordinates, lists; amounts stay readable."""
    key = F.col("c_custkey")
    customer = t("customer").select(
        F.lit("customer").alias("source"),
        key.alias("id"),
        F.concat("c_name", F.lit(" Foods")).alias("name"),
        (9_000_000_000 + key).cast("string").alias("phone"),
        F.concat(F.lit("u"), key, F.lit("@icici")).alias("vpa"),
        ((F.col("c_acctbal") + 2000) / 100.0).alias("latitude"),
        F.array(F.concat(F.lit("C"), key), key.cast("string")).alias("customer_ids"),
        F.col("c_acctbal").alias("amount"),
    )
    none = F.lit(None)
    supplier = t("supplier").select(
        F.lit("supplier").alias("source"),
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        none.cast("string").alias("phone"),
        F.lit("").alias("vpa"),
        none.cast("double").alias("latitude"),
        F.array().cast("array<string>").alias("customer_ids"),
        F.col("s_acctbal").alias("amount"),
    )
    masked = masks.mask_frame(customer.unionByName(supplier))
    return masked.withColumn("customer_ids", F.array_join("customer_ids", ","))


@query(
    "mask_after_search",
    f"""SELECT '{{"c_custkey":' || c_custkey || '}}' AS record_key,
  {sql_words("c_name || ' ' || c_mktsegment")} AS summary
FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '99 auto')""",
)
def mask_after_search(t: Tables) -> DataFrame:
    """The real name is matched, only the masked one is shown."""
    rows = t("customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))
    return records.search_hits("person", rows, "99 AUTO", masked=True).drop("domain")


SQL_ASSIGNED = (
    r"""(?i:token|secret|passw(?:or)?d|api[_\-]?key)["'']?\s*[:=]\s*["'']?"""
    r"""[^\s"''&,;<>{}\[\]]{8,}"""
)
SQL_LEAD = r"""^(?i:token|secret|passw(?:or)?d|api[_\-]?key)["'']?\s*[:=]\s*["'']?"""


@query(
    "redact_secrets",
    f"""WITH src AS (SELECT doc_id, text AS s FROM documents), r AS (SELECT doc_id, s,
  {sql_rejoin("s", SQL_ASSIGNED, f"regexp_extract(m, '{SQL_LEAD}') || '<redacted:' || (length(m) - length(regexp_extract(m, '{SQL_LEAD}'))) || ' chars>'")}
    AS out FROM src)
SELECT doc_id, md5(out) AS redacted_md5, out <> s AS changed, length(out) AS n_chars FROM r""",
)
def redact_secrets(t: Tables) -> DataFrame:
    texts = spread(t("documents").select("doc_id", "text"))
    out = texts.select("*", secrets.redact_text("text").alias("out"))
    return out.select(
        "doc_id",
        F.md5(F.col("out").cast("binary")).alias("redacted_md5"),
        (F.col("out") != F.col("text")).alias("changed"),
        F.length("out").cast("bigint").alias("n_chars"),
    )


@query(
    "redact_settings",
    """WITH kv AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'session_key' WHEN 1 THEN 'theme'
    WHEN 2 THEN 'Auth' || event_type ELSE 'note' END AS key,
    CASE event_id % 4 WHEN 3 THEN 'Bearer abcdefgh' || event_id ELSE props END AS value FROM events)
SELECT event_id, key, CASE WHEN key IN ('session_key') OR key LIKE 'Auth%'
    THEN '<redacted:' || length(value) || ' chars>'
  WHEN key = 'note' THEN 'Bearer <redacted:' || (length(value) - 7) || ' chars>' ELSE value END AS value,
  CASE WHEN key = 'theme' THEN value ELSE '<redacted:' || length(value) || ' chars>' END AS setting
FROM kv""",
)
def redact_settings(t: Tables) -> DataFrame:
    n = F.col("event_id") % 4
    key = (
        F.when(n == 0, "session_key")
        .when(n == 1, "theme")
        .when(n == 2, F.concat(F.lit("Auth"), "event_type"))
        .otherwise("note")
    )
    value = F.when(n == 3, F.concat(F.lit("Bearer abcdefgh"), "event_id")).otherwise(F.col("props"))
    kv = t("events").select("event_id", key.alias("key"), value.alias("value"))
    return kv.select(
        "event_id",
        "key",
        secrets.redact_value("key", "value").alias("value"),
        secrets.redact_setting("key", "value").alias("setting"),
    )


@query(
    "leak_gate",
    """WITH runs AS (SELECT source, text, source = 'src3' AS waived,
    regexp_extract_all(text, '[0-9a-fA-F]+') AS r FROM documents)
SELECT source, count(*) AS n_texts,
  count(*) FILTER (NOT waived AND len(list_filter(r, lambda x: regexp_full_match(x, '[6-9][0-9]{9}'))) > 0)
    AS n_mobile,
  count(*) FILTER (NOT waived AND len(list_filter(r, lambda x: regexp_full_match(x, '[0-9]{12}'))) > 0)
    AS n_rrn,
  count(*) FILTER (NOT waived AND len(list_filter(r, lambda x: regexp_full_match(x, '[0-9]{19}'))) > 0)
    AS n_long_id,
  count(*) FILTER (contains(text, 'example.com') OR contains(text, 'token = ')) AS n_literal
FROM runs GROUP BY 1""",
)
def leak_gate(t: Tables) -> DataFrame:
    return quality.leak_counts(
        spread(t("documents").select("source", "text")), ["source"], "text", ["example.com", "token = "], F.col("source") == "src3"
    )


@query(
    "token_hygiene",
    r"""SELECT 'documents' AS domain, 'text' AS field, count(*) AS n_hits FROM documents
WHERE regexp_matches(text, 'eyJ[A-Za-z0-9_\-]{20,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[A-Za-z0-9+/]{60,}={0,2}')
HAVING count(*) > 0""",
)
def token_hygiene(t: Tables) -> DataFrame:
    return quality.token_hygiene(
        {"documents": spread(t("documents").select("text", "lang", "source")), "part": t("part").select("p_name")}
    )


@query(
    "ciphertext_shape",
    r"""WITH bodies AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN base64(encode(text)) WHEN 1 THEN
    '{"a":"' || base64(encode(text)) || '"}' WHEN 2 THEN left(base64(encode(text)), 40) ELSE text END AS body
  FROM documents)
SELECT doc_id, regexp_full_match(body, '[A-Za-z0-9+/\s]{64,}={0,2}\s*') AND
  NOT regexp_matches(body, '^\s*[\[{]') AS ciphertext FROM bodies""",
)
def ciphertext_shape(t: Tables) -> DataFrame:
    n = F.col("doc_id") % 4
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n]", "")
    body = (
        F.when(n == 0, coded)
        .when(n == 1, F.concat(F.lit('{"a":"'), coded, F.lit('"}')))
        .when(n == 2, F.left(coded, F.lit(40)))
        .otherwise(F.col("text"))
    )
    texts = spread(t("documents").select("doc_id", "text"))
    return texts.select("doc_id", parties.ciphertext_shaped(body).alias("ciphertext"))


@query(
    "previous_row_redact",
    """WITH pairs AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before
  FROM conversations)
SELECT conv_id, turn, CASE WHEN before = 'system' OR role = 'system'
  THEN '<redacted:' || length(text) || ' chars>' ELSE text END AS shown FROM pairs""",
)
def previous_row_redact(t: Tables) -> DataFrame:
    """A value is cut to its length when the marker is on it or on the row before it."""
    rows = scan_in_order(t("conversations"), ["conv_id"], ["turn"], {"before": "role"})
    marked = (F.col("before") == "system") | (F.col("role") == "system")
    return rows.select(
        "conv_id",
        "turn",
        F.when(marked, secrets.redaction(F.col("text")))
        .otherwise(F.col("text"))
        .alias("shown"),
    )
