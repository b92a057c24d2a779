"""Entity queries: customers and suppliers as people, documents as records that share identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import codes, parties
from ...operators import analytics, entities, quality
from ...operators.components import label_records
from ...operators.skew import first_per_key, last_per_key
from ...schemas import conform, provenance
from ...session import cut_lineage, spread
from .base import Tables, query, sql_money

# ---- shared shapes -----------------------------------------------------------------------------


def people(t: Tables) -> DataFrame:
    """Two sources of people. Customers 2n and 2n+1 share a phone; every supplier shares the handle
    of one customer and spells its name with a company suffix."""
    key = F.col("c_custkey")
    customers = t("customer").select(
        F.concat(F.lit("C"), key).alias("customer_id"),
        F.col("c_name").alias("name"),
        (6_000_000_000 + F.floor(key / 2)).cast("string").alias("phone"),
        F.array(F.concat(F.lit("u"), key, F.lit("@icici"))).alias("vpas"),
        F.concat(F.lit("sb"), key).alias("sendbird_id"),
        F.when(key % 2 == 0, "CUSTOMER").alias("person_type"),
        (key == 1).alias("is_subject"),
        F.when(key % 5 == 0, F.concat(F.lit("since "), F.col("c_nationkey"))).alias(
            "account_age_text"
        ),
        provenance("customers", "customer", key).alias("provenance"),
    )
    s = F.col("s_suppkey")
    suppliers = t("supplier").select(
        F.concat(F.col("s_name"), F.lit(" Pvt Ltd")).alias("name"),
        F.array(F.concat(F.lit("u"), s * 3, F.lit("@icici"))).alias("vpas"),
        F.lit("MERCHANT").alias("person_type"),
        F.lit(False).alias("is_subject"),
        provenance("suppliers", "supplier", s).alias("provenance"),
    )
    case = F.lit("case").alias("case_id")
    return conform(customers.select(case, "*"), "person").unionByName(
        conform(suppliers.select(case, "*"), "person")
    )


def party_ledger(t: Tables) -> DataFrame:
    """Orders as ledger rows that name their counterparty by handle, name or phone. Keys ending in
    9 belong to parties nobody lists."""
    key, n = F.col("o_custkey"), F.col("o_orderkey")
    listed = key % 10 != 9
    handle = F.when(listed, F.concat(F.lit("u"), key, F.lit("@icici"))).otherwise(
        F.concat(F.lit("x"), key, F.lit("@ybl"))
    )
    name = F.when(
        listed, F.concat(F.lit("CUSTOMER#"), F.lpad(key.cast("string"), 9, "0"), F.lit(" Limited"))
    ).otherwise(F.concat(F.lit("Stall "), key))
    phone = F.when(listed, 6_000_000_000 + F.floor(key / 2)).otherwise(7_000_000_000 + key)
    return t("orders").select(
        F.lit("case").alias("case_id"),
        F.when(n % 3 == 0, handle).alias("counterparty_vpa"),
        F.when(n % 3 <= 1, name).alias("counterparty_name"),
        F.when(n % 3 == 2, phone.cast("string")).alias("counterparty_mobile"),
        F.col("o_totalprice").alias("amount"),
        codes.txn_direction(n % 2 + 1).alias("direction"),
        (F.col("o_orderstatus") == "F").alias("settled"),
        provenance("orders", "orders", n).alias("provenance"),
    )


def event_messages(t: Tables) -> DataFrame:
    return t("events").select(
        F.lit("case").alias("case_id"),
        F.concat(F.lit("sb"), F.col("user_id")).alias("sender_id"),
    )


SQL_PEOPLE = """people AS (
  SELECT 'C' || c_custkey AS customer_id, c_name AS name,
    CAST(6000000000 + c_custkey // 2 AS VARCHAR) AS phone, 'u' || c_custkey || '@icici' AS vpa,
    'sb' || c_custkey AS sendbird_id, CASE WHEN c_custkey % 2 = 0 THEN 'CUSTOMER' END AS person_type,
    c_custkey = 1 AS is_subject,
    CASE WHEN c_custkey % 5 = 0 THEN 'since ' || c_nationkey END AS account_age_text,
    'customers' AS source_file, c_custkey AS seq, NULL AS seed_key FROM customer
  UNION ALL
  SELECT NULL, s_name || ' Pvt Ltd', NULL, 'u' || (s_suppkey * 3) || '@icici', NULL, 'MERCHANT',
    false, NULL, 'suppliers', s_suppkey, NULL FROM supplier),
txns AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 10 <> 9
      THEN 'u' || o_custkey || '@icici' ELSE 'x' || o_custkey || '@ybl' END END AS vpa,
    CASE WHEN o_orderkey % 3 <= 1 THEN CASE WHEN o_custkey % 10 <> 9
      THEN 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' Limited'
      ELSE 'Stall ' || o_custkey END END AS name,
    CASE WHEN o_orderkey % 3 = 2 THEN CAST(CASE WHEN o_custkey % 10 <> 9
      THEN 6000000000 + o_custkey // 2 ELSE 7000000000 + o_custkey END AS VARCHAR) END AS phone,
    o_totalprice AS amount,
    CASE WHEN o_orderkey % 2 = 0 THEN 'credit' ELSE 'debit' END AS direction,
    o_orderstatus = 'F' AS settled FROM orders)"""

SUFFIX = (
    r"\b(private limited|pvt\.? ?ltd\.?|pvt\.? limited|limited|ltd\.?|inc\.?|llp"
    r"|technologies|technology|india)\b"
)


def sql_name_key(x: str) -> str:
    return (
        f"nullif(regexp_replace(regexp_replace(lower({x}), '{SUFFIX}', ' ', 'g'), "
        f"'[^a-z0-9]+', '', 'g'), '')"
    )


SQL_KNOWN = f"""known AS (
  SELECT 'vpa' AS kind, vpa AS value FROM people WHERE vpa IS NOT NULL
  UNION SELECT 'phone', phone FROM people WHERE phone IS NOT NULL
  UNION SELECT 'name', {sql_name_key('name')} FROM people WHERE name IS NOT NULL)"""

SQL_UNKNOWN = f"""unknown AS (
  SELECT DISTINCT vpa, name, phone, {sql_name_key('name')} AS name_key FROM txns t
  WHERE NOT EXISTS (SELECT 1 FROM known WHERE kind = 'vpa' AND value = t.vpa)
    AND NOT EXISTS (SELECT 1 FROM known WHERE kind = 'name' AND value = {sql_name_key('t.name')})
    AND NOT EXISTS (SELECT 1 FROM known WHERE kind = 'phone' AND value = t.phone))"""


# ---- queries -----------------------------------------------------------------------------------


def owner_keys(t: Tables) -> DataFrame:
    """(case_id, kind, value, component) of every third customer: the parties we can name."""
    key = F.col("c_custkey")
    kinds = F.array(
        F.struct(F.lit("vpa").alias("kind"), F.concat(F.lit("u"), key, F.lit("@icici")).alias("value")),
        F.struct(F.lit("name").alias("kind"), parties.party_name_key("c_name").alias("value")),
    )
    return (
        t("customer")
        .where(key % 3 != 0)
        .select(F.lit("case").alias("case_id"), key.alias("component"), F.explode(kinds).alias("k"))
        .select("case_id", "k.kind", "k.value", "component")
        .unionByName(
            t("customer")
            .where(key % 4 == 0)
            .select(
                F.lit("case").alias("case_id"),
                F.lit("phone").alias("kind"),
                (6_000_000_000 + F.floor(key / 2)).cast("string").alias("value"),
                key.alias("component"),
            )
        )
    )


@query(
    "entity_attribution",
    f"""WITH {SQL_PEOPLE}, named AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0),
phoned AS (SELECT *, CAST(6000000000 + c_custkey // 2 AS VARCHAR) AS phone FROM customer
  WHERE c_custkey % 4 = 0),
owned AS (
  SELECT t.*, coalesce(a.c_custkey, b.c_custkey, c.c_custkey) AS component FROM txns t
  LEFT JOIN named a ON t.vpa = 'u' || a.c_custkey || '@icici'
  LEFT JOIN named b ON {sql_name_key('t.name')} = {sql_name_key('b.c_name')}
  LEFT JOIN phoned c ON t.phone = c.phone)
SELECT component, CAST(count(*) AS BIGINT) AS txn_count,
  {sql_money('amount', "settled AND direction = 'credit'")} AS received,
  {sql_money('amount', "settled AND direction = 'debit'")} AS paid
FROM owned WHERE component IS NOT NULL GROUP BY 1""",
)
def entity_attribution(t: Tables) -> DataFrame:
    found = entities.attribute(entities.ledger_parties(party_ledger(t)), owner_keys(t))
    return found.groupBy("component").agg(
        F.sum("txn_count").alias("txn_count"),
        F.sum("received").cast("double").alias("received"),
        F.sum("paid").cast("double").alias("paid"),
    )


def document_keys(t: Tables) -> DataFrame:
    """What two documents may share: the whole text, any e-mail address, source and length."""
    emails = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+"), F.lit(0)))
    single = [
        F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        for kind, value in (
            ("text", F.md5(F.col("text").cast("binary"))),
            ("shape", F.concat_ws("/", "source", F.col("n_chars").cast("string"))),
        )
    ]
    empty = F.array().cast("array<string>")
    found = F.transform(F.coalesce(emails, empty), lambda e: F.struct(F.lit("email").alias("kind"), e.alias("value")))
    keys = (
        spread(t("documents").select("doc_id", "text", "source", "n_chars"))
        .select("doc_id", F.explode(F.concat(F.array(*single), found)).alias("k"))
        .select("doc_id", "k.kind", "k.value")
        .where("value IS NOT NULL")
    )
    # the texts are read once; everything after works on these short keys
    return cut_lineage(keys)


def labelled_documents(t: Tables, keys: DataFrame) -> DataFrame:
    return label_records(t("documents").select("doc_id"), keys, "doc_id", ["kind", "value"])


SQL_DOC_COMPONENTS = """keys AS MATERIALIZED (
  SELECT doc_id, 'text' AS kind, md5(text) AS value FROM documents
  UNION ALL SELECT doc_id, 'email', unnest(list_distinct(regexp_extract_all(text,
    '[A-Za-z0-9_.]+@[A-Za-z0-9_.]+'))) FROM documents
  UNION ALL SELECT doc_id, 'shape', source || '/' || n_chars FROM documents),
edges AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
  FROM keys a JOIN keys b USING (kind, value) WHERE a.doc_id <> b.doc_id),
reach AS (SELECT doc_id, doc_id AS label FROM documents
  UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.label < e.b),
components AS (SELECT doc_id, min(label) AS component FROM reach GROUP BY 1)"""


@query("entity_components", f"WITH RECURSIVE {SQL_DOC_COMPONENTS} SELECT * FROM components")
def entity_components(t: Tables) -> DataFrame:
    return labelled_documents(t, document_keys(t))


@query(
    "entity_key_collisions",
    f"""WITH RECURSIVE {SQL_DOC_COMPONENTS}, owners AS (
  SELECT kind, value, count(DISTINCT component) AS n, count(DISTINCT doc_id) AS docs
  FROM keys JOIN components USING (doc_id) WHERE value IS NOT NULL GROUP BY ALL)
SELECT kind, count(*) AS n_keys, count(*) FILTER (docs > 1) AS n_shared_keys,
  count(*) FILTER (n > 1) AS n_collisions FROM owners GROUP BY 1""",
)
def entity_key_collisions(t: Tables) -> DataFrame:
    """No identifier may end up in two entities."""
    keys = document_keys(t)
    owned = keys.join(labelled_documents(t, keys), "doc_id")
    clashes = quality.shared_identifiers(owned, "component", ["kind", "value"])
    per_key = keys.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_docs"))
    return (
        per_key.join(clashes, ["kind", "value"], "left")
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("n_keys"),
            F.count_if(F.col("n_docs") > 1).alias("n_shared_keys"),
            F.count_if(F.col("n_owners").isNotNull()).alias("n_collisions"),
        )
    )


@query(
    "entity_seed_unknown",
    f"""WITH {SQL_PEOPLE}, {SQL_KNOWN}, {SQL_UNKNOWN}
SELECT CASE WHEN vpa IS NOT NULL THEN 'vpa:' || vpa
    WHEN name IS NOT NULL THEN 'name:' || coalesce(name_key, lower(name))
    ELSE 'phone:' || phone END AS seed_key,
  count(*) AS n_records, count(vpa) AS n_with_handle, count(name) AS n_with_name,
  count(phone) AS n_with_phone
FROM unknown WHERE coalesce(vpa, name, phone) IS NOT NULL GROUP BY 1""",
)
def entity_seed_unknown(t: Tables) -> DataFrame:
    keys = entities.join_keys(entities.person_records(people(t)))
    seeds = entities.seed_parties(entities.ledger_parties(party_ledger(t)), keys)
    return seeds.groupBy("seed_key").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.size("vpas") > 0).alias("n_with_handle"),
        F.count("name").alias("n_with_name"),
        F.count("phone").alias("n_with_phone"),
    )


@query(
    "entity_profile",
    f"""WITH RECURSIVE {SQL_PEOPLE}, {SQL_KNOWN}, {SQL_UNKNOWN}, records AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY source_file, seq, name, vpa, phone) AS id, * FROM (
    SELECT * FROM people UNION ALL
    SELECT NULL, name, phone, vpa, NULL, NULL, false, NULL, 'orders', 9000000000,
      CASE WHEN vpa IS NOT NULL THEN 'vpa:' || vpa
        WHEN name IS NOT NULL THEN 'name:' || coalesce(name_key, lower(name))
        ELSE 'phone:' || phone END FROM unknown)),
keys AS MATERIALIZED (
  SELECT id, 'cid' AS kind, customer_id AS value FROM records
  UNION ALL SELECT id, 'phone', phone FROM records UNION ALL SELECT id, 'vpa', vpa FROM records
  UNION ALL SELECT id, 'sb', sendbird_id FROM records
  UNION ALL SELECT id, 'name', {sql_name_key('name')} FROM records
  UNION ALL SELECT id, 'seed', seed_key FROM records),
edges AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b USING (kind, value)
  WHERE a.id <> b.id),
reach AS (SELECT id, id AS label FROM records
  UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.id WHERE r.label < e.b),
comp AS MATERIALIZED (SELECT id, min(label) AS component FROM reach GROUP BY 1),
own AS MATERIALIZED (SELECT DISTINCT kind, value, component FROM keys JOIN comp USING (id)
  WHERE value IS NOT NULL),
owned AS (
  SELECT t.*, coalesce(a.component, b.component, c.component) AS component FROM txns t
  LEFT JOIN own a ON a.kind = 'vpa' AND a.value = t.vpa
  LEFT JOIN own b ON b.kind = 'name' AND b.value = {sql_name_key('t.name')}
  LEFT JOIN own c ON c.kind = 'phone' AND c.value = t.phone),
totals AS (SELECT component, count(*) AS txn_count,
  {sql_money('amount', "settled AND direction = 'credit'")} AS total_received,
  {sql_money('amount', "settled AND direction = 'debit'")} AS total_paid
  FROM owned WHERE component IS NOT NULL GROUP BY 1),
spoken AS (SELECT component, count(*) AS msg_count FROM events
  JOIN own ON own.kind = 'sb' AND own.value = 'sb' || user_id GROUP BY 1),
facts AS (SELECT component, list_sort(list_distinct(list(name))) AS names,
  list_sort(list_distinct(list(phone))) AS phones, list_sort(list_distinct(list(vpa))) AS vpas,
  list_sort(list_distinct(list(customer_id))) AS customer_ids,
  list_sort(list_distinct(list(source_file))) AS source_files,
  first(person_type ORDER BY CASE WHEN source_file = 'orders' THEN '~' ELSE source_file END, seq)
    FILTER (person_type IS NOT NULL) AS person_type,
  first(account_age_text ORDER BY source_file, seq) FILTER (account_age_text IS NOT NULL)
    AS account_age_text,
  bool_or(is_subject) AS is_subject
  FROM records JOIN comp USING (id) GROUP BY 1)
SELECT array_to_string(names, '|') AS names, array_to_string(phones, '|') AS phones,
  array_to_string(vpas, '|') AS vpas, array_to_string(customer_ids, '|') AS customer_ids,
  array_to_string(source_files, '|') AS source_files,
  person_type, account_age_text, is_subject, coalesce(txn_count, 0) AS txn_count,
  coalesce(total_received, 0) AS total_received, coalesce(total_paid, 0) AS total_paid,
  coalesce(msg_count, 0) AS msg_count
FROM facts LEFT JOIN totals USING (component) LEFT JOIN spoken USING (component)""",
)
def entity_profile(t: Tables) -> DataFrame:
    table = entities.entity_table(people(t), party_ledger(t), event_messages(t))
    lists = ["names", "phones", "vpas", "customer_ids", "source_files"]
    return table.select(
        *[F.array_join(c, "|").alias(c) for c in lists],
        "person_type", "account_age_text", "is_subject", "txn_count", "total_received",
        "total_paid", "msg_count",
    )


NAME_FORMS = (
    ("customer", "c_custkey", "c_name", " Pvt Ltd"),
    ("supplier", "s_suppkey", "s_name", " PRIVATE LIMITED"),
    ("part", "p_partkey", "p_name", " Technologies, India"),
)


@query(
    "name_normalise",
    " UNION ALL ".join(
        f"SELECT '{table}' AS source, {key} AS id, {name} || '{form}' AS name, "
        f"{sql_name_key(f'''{name} || '{form}' ''')} AS name_key FROM {table}"
        for table, key, name, form in NAME_FORMS
    ),
)
def name_normalise(t: Tables) -> DataFrame:
    parts = [
        t(table)
        .select(F.col(key).alias("id"), F.concat(F.col(name), F.lit(form)).alias("name"))
        .select(
            F.lit(table).alias("source"), "id", "name", parties.party_name_key("name").alias("name_key")
        )
        for table, key, name, form in NAME_FORMS
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "subject_profile",
    """WITH subject AS (SELECT * FROM customer QUALIFY
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1),
banks AS (SELECT s_nationkey, string_agg(DISTINCT 'Bank ' || (s_suppkey % 7), ', '
    ORDER BY 'Bank ' || (s_suppkey % 7)) AS banks FROM supplier GROUP BY 1)
SELECT CAST(c_nationkey AS VARCHAR) AS case_id, c_name AS name, 'C' || c_custkey AS customer_id,
  coalesce(CASE WHEN c_nationkey % 2 = 0 THEN 'Own Bank' END, banks) AS bank_name,
  n_name AS kyc_state
FROM subject LEFT JOIN banks ON s_nationkey = c_nationkey
LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def subject_profile(t: Tables) -> DataFrame:
    """One case per nation: its first customer is the owner, its suppliers are the linked banks."""
    first = t("customer").select(
        F.col("c_nationkey").cast("string").alias("case_id"),
        F.concat(F.lit("C"), F.col("c_custkey")).alias("customer_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") % 2 == 0, "Own Bank").alias("bank_name"),
        F.lit(True).alias("is_subject"),
        provenance("customers", "customer", F.col("c_custkey")).alias("provenance"),
    )
    accounts = t("supplier").select(
        F.col("s_nationkey").cast("string").alias("case_id"),
        F.concat(F.lit("Bank "), F.col("s_suppkey") % 7).alias("bank_name"),
    )
    prefs = t("nation").select(
        F.col("n_nationkey").cast("string").alias("case_id"),
        F.lit("kyc_state").alias("key"),
        F.col("n_name").alias("value"),
        provenance("nations", "nation").alias("provenance"),
    )
    profile = analytics.subject_profile(conform(first, "person"), accounts, prefs)
    return profile.select("case_id", "name", "customer_id", "bank_name", "kyc_state")


@query(
    "contact_enrichment",
    """WITH first_order AS (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS first_priority
  FROM orders GROUP BY 1),
last_event AS (SELECT user_id, max_by(event_type, event_id) AS last_type,
  max(event_id) AS last_id FROM events GROUP BY 1)
SELECT c_custkey, coalesce(first_priority, c_mktsegment) AS phone,
  coalesce(last_type, 'CONTACT') AS person_type, last_id AS enrichment_id
FROM customer LEFT JOIN first_order ON o_custkey = c_custkey LEFT JOIN last_event ON user_id = c_custkey""",
)
def contact_enrichment(t: Tables) -> DataFrame:
    """First row of one side table, last row of another, own columns where both are silent."""
    first = first_per_key(t("orders"), ["o_custkey"], ["o_orderkey"], ["o_orderpriority"])
    last = last_per_key(t("events"), ["user_id"], ["event_id"], ["event_type", "event_id"])
    c = t("customer").select("c_custkey", "c_mktsegment")
    return (
        c.join(first.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(last.withColumnRenamed("user_id", "c_custkey"), "c_custkey", "left")
        .select(
            "c_custkey",
            F.coalesce("o_orderpriority", "c_mktsegment").alias("phone"),
            F.coalesce("event_type", F.lit("CONTACT")).alias("person_type"),
            F.col("event_id").alias("enrichment_id"),
        )
    )


#: handle suffixes and bank prefixes the generated handles and account texts go through
SUFFIXES = ("ICICI", "okaxis", "ybl", "apl", "nosuch", "")
PREFIXES = ("HDFC", "BARB", "SBIN", "ZZZZ", "utib")
USERS = ("u", "swiggy.", "rzp-", "averyveryverylongusername", "")


def _pick(options: tuple[str, ...], n) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


def _sql_pick(options: tuple[str, ...], n: str) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"([{listed}])[{n} % {len(options)} + 1]"


@query(
    "handle_functions",
    f"""WITH made AS (SELECT c_custkey,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {_sql_pick(USERS, 'c_custkey')} ||
      CASE WHEN c_custkey % 11 = 0 THEN 'nohandle' ELSE (c_custkey % 97) || '@' ||
        {_sql_pick(SUFFIXES, 'c_nationkey')} END END AS vpa,
    CASE WHEN c_custkey % 17 = 0 THEN 'no code' ELSE '0' || (c_custkey % 1000) || '_' ||
      {_sql_pick(PREFIXES, 'c_custkey')} || '0' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END
      AS account FROM customer),
cut AS (SELECT *, nullif(split_part(vpa, '@', 1), '') AS vpa_user,
    CASE WHEN contains(vpa, '@') THEN lower(substr(vpa, instr(vpa, '@') + 1)) END AS vpa_suffix,
    nullif(regexp_extract(upper(account), '[A-Z]{{4}}0[A-Z0-9]{{6}}'), '') AS code FROM made)
SELECT c_custkey, vpa_user, vpa_suffix,
  CASE nullif(vpa_suffix, '') WHEN 'icici' THEN 'ICICI Bank' WHEN 'okaxis' THEN 'Axis (Google Pay)'
    WHEN 'ybl' THEN 'Yes Bank (PhonePe)' WHEN 'apl' THEN 'Amazon Pay' ELSE nullif(vpa_suffix, '') END
    AS provider,
  coalesce(contains(lower(vpa_user), 'swiggy') OR contains(lower(vpa_user), 'rzp')
    OR length(vpa_user) > 18, false) AS merchant,
  CASE code[1:4] WHEN 'HDFC' THEN 'HDFC Bank' WHEN 'BARB' THEN 'Bank of Baroda'
    WHEN 'SBIN' THEN 'State Bank of India' WHEN 'UTIB' THEN 'Axis Bank' END AS bank,
  right(code, 6) AS branch
FROM cut""",
)
def handle_functions(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    suffix = F.concat((key % 97).cast("string"), F.lit("@"), _pick(SUFFIXES, F.col("c_nationkey")))
    vpa = F.when(
        key % 13 != 0,
        F.concat(_pick(USERS, key), F.when(key % 11 == 0, "nohandle").otherwise(suffix)),
    )
    account = F.when(key % 17 == 0, "no code").otherwise(
        F.concat(
            F.lit("0"), key % 1000, F.lit("_"), _pick(PREFIXES, key), F.lit("0"),
            F.lpad(key.cast("string"), 6, "0"),
        )
    )
    made = t("customer").select("c_custkey", vpa.alias("vpa"), account.alias("account"))
    return made.select(
        "c_custkey",
        parties.handle_user("vpa").alias("vpa_user"),
        parties.handle_suffix("vpa").alias("vpa_suffix"),
        parties.handle_provider("vpa").alias("provider"),
        parties.looks_like_merchant("vpa").alias("merchant"),
        codes.bank_name("account").alias("bank"),
        codes.bank_branch("account").alias("branch"),
    )


@query(
    "key_space_overlap",
    """WITH sides AS (
  SELECT 'customer-orders' AS pair, (SELECT count(DISTINCT c_custkey) FROM customer) AS n_left,
    (SELECT count(DISTINCT o_custkey) FROM orders) AS n_right,
    (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders))
      AS n_both
  UNION ALL SELECT 'customer-events', (SELECT count(DISTINCT c_custkey) FROM customer),
    (SELECT count(DISTINCT user_id) FROM events),
    (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)))
SELECT * FROM sides""",
)
def key_space_overlap(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("id"))
    parts = [
        quality.key_overlap(c, other, "id").select(F.lit(pair).alias("pair"), "*")
        for pair, other in (
            ("customer-orders", t("orders").select(F.col("o_custkey").alias("id"))),
            ("customer-events", t("events").select(F.col("user_id").alias("id"))),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "name_harvest",
    """SELECT c_name AS name FROM customer WHERE length(c_name) > 2
UNION SELECT s_name FROM supplier WHERE length(s_name) > 2
UNION SELECT p_name FROM part WHERE length(p_name) > 2""",
)
def name_harvest(t: Tables) -> DataFrame:
    from ...operators.masking import known_names

    case = F.lit("case").alias("case_id")
    person = t("customer").select(
        case, F.col("c_name").alias("name"), F.lit(None).cast("string").alias("verified_name")
    )
    entity = t("supplier").select(case, F.array("s_name").alias("names"))
    txn = t("part").select(case, F.col("p_name").alias("counterparty_name"))
    return known_names({"person": person, "entity": entity, "transaction": txn}).select("name")


@query(
    "first_occurrence",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey
  ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1""",
)
def first_occurrence(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    return first_per_key(t("lineitem"), ["l_partkey"], order, order[:3])
