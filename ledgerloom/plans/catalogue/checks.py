"""Integrity, reconciliation and data-quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import codes
from ...operators import integrity, quality
from ...schemas import provenance
from ..normalisers.settings import changed_from_default
from .base import Tables, query
from .ledgers import SQL_EVENT_LEDGER, SQL_LEDGER, event_ledger, order_ledger


@query(
    "manifest_hash",
    """SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS size FROM documents""",
)
def manifest_hash(t: Tables) -> DataFrame:
    return integrity.content_digest(t("documents"), "doc_id", "text")


def order_manifest(t: Tables) -> DataFrame:
    body = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return t("orders").select(
        F.concat(F.lit("orders/"), "o_orderkey").alias("path"),
        F.col("o_orderkey").alias("n"),
        F.sha2(body.cast("binary"), 256).alias("sha256"),
        F.md5(body.cast("binary")).alias("md5"),
    )


SQL_MANIFEST = """manifest AS (SELECT 'orders/' || o_orderkey AS path, o_orderkey AS n,
    o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority AS body FROM orders)"""


@query(
    "manifest_diff",
    f"""WITH {SQL_MANIFEST}
SELECT path, CASE WHEN n % 10 = 3 THEN 'missing' ELSE 'changed' END AS status, sha256(body) AS old_sha256,
  CASE WHEN n % 10 = 4 THEN sha256(body || 'x') END AS new_sha256 FROM manifest WHERE n % 10 IN (3, 4)
UNION ALL SELECT path || '.new', 'added', NULL, sha256(body) FROM manifest WHERE n % 10 = 5""",
)
def manifest_diff(t: Tables) -> DataFrame:
    """A tenth of the files removed, a tenth altered, a tenth copied under new names."""
    old = order_manifest(t)
    body = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    altered = t("orders").where("o_orderkey % 10 = 4").select(
        F.concat(F.lit("orders/"), "o_orderkey").alias("path"),
        F.sha2(F.concat(body, F.lit("x")).cast("binary"), 256).alias("sha256"),
    )
    kept = old.where("n % 10 NOT IN (3, 4)").select("path", "sha256")
    copies = old.where("n % 10 = 5").select(
        F.concat("path", F.lit(".new")).alias("path"), "sha256"
    )
    return integrity.manifest_diff(old, kept.unionByName(altered).unionByName(copies), ["path"])


@query(
    "manifest_checks",
    """SELECT count(*) AS n_files, count(*) FILTER (o_orderkey % 100 = 0) AS n_bad_sha256,
  count(*) FILTER (o_orderkey % 50 = 0) AS n_bad_md5, count(DISTINCT o_orderkey) AS n_paths FROM orders""",
)
def manifest_checks(t: Tables) -> DataFrame:
    damaged = order_manifest(t).select(
        "path",
        F.when(F.col("n") % 100 != 0, F.col("sha256")).alias("sha256"),
        F.when(F.col("n") % 50 == 0, "short").otherwise(F.col("md5")).alias("md5"),
    )
    return quality.manifest_checks(damaged)


@query(
    "snapshot_row_delta",
    """WITH b AS (SELECT o_orderstatus AS tbl, count(*) AS n_before FROM orders
    WHERE o_orderkey % 4 <> 1 OR o_orderstatus = 'F' GROUP BY 1),
a AS (SELECT o_orderstatus AS tbl, count(*) AS n_after FROM orders
    WHERE o_orderstatus <> 'F' OR o_orderkey % 6 <> 0 GROUP BY 1
  UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1)
SELECT tbl, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after,
  greatest(coalesce(n_after, 0) - coalesce(n_before, 0), 0) AS net_hidden,
  greatest(coalesce(n_before, 0) - coalesce(n_after, 0), 0) AS net_deleted
FROM b FULL JOIN a USING (tbl) WHERE coalesce(n_before, 0) <> coalesce(n_after, 0)""",
)
def snapshot_row_delta(t: Tables) -> DataFrame:
    table = F.col("o_orderstatus").alias("tbl")
    before = t("orders").where("o_orderkey % 4 <> 1 OR o_orderstatus = 'F'").select(table)
    after = t("orders").where("o_orderstatus <> 'F' OR o_orderkey % 6 <> 0").select(table)
    after = after.unionByName(t("events").select(F.col("event_type").alias("tbl")))
    return integrity.row_count_delta(before, after, ["tbl"])


@query(
    "table_digest",
    """WITH rows AS (SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderdate":"' ||
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' ||
    o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}' AS j
  FROM orders)
SELECT o_orderkey % 16 AS bucket, count(*) AS n_rows,
  CAST(sum(CAST('0x' || left(md5(j), 15) AS BIGINT)) AS VARCHAR) AS digest FROM rows GROUP BY 1""",
)
def table_digest(t: Tables) -> DataFrame:
    return integrity.table_digest(t("orders"), F.col("o_orderkey") % 16, t("orders").columns)


@query(
    "chain_verify",
    """WITH e AS (SELECT user_id, event_id, event_id || '/' || event_type AS body,
    sha256('seed' || event_id || '/' || event_type) AS own FROM events),
linked AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64))
    AS prev FROM e),
sealed AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'forged' ELSE prev END AS prev_hash,
    CASE WHEN event_id % 89 = 0 THEN 'edited' ELSE own END AS entry_hash, own AS expected_hash FROM linked),
seen AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY user_id ORDER BY event_id),
    repeat('0', 64)) AS before FROM sealed)
SELECT user_id, event_id, 'prev_hash does not chain' AS reason FROM seen WHERE prev_hash <> before
UNION ALL SELECT user_id, event_id, 'entry_hash mismatch (edited?)' FROM seen
WHERE expected_hash <> entry_hash""",
)
def chain_verify(t: Tables) -> DataFrame:
    """Sealed event logs per user, some links forged and some entries edited, then verified."""
    from ...operators.skew import scan_in_order

    own = F.sha2(F.concat(F.lit("seed"), "event_id", F.lit("/"), "event_type").cast("binary"), 256)
    entries = t("events").select("user_id", "event_id", own.alias("own"))
    linked = scan_in_order(entries, ["user_id"], ["event_id"], {"before": "own"})
    forged, edited = F.col("event_id") % 97 == 0, F.col("event_id") % 89 == 0
    sealed = linked.select(
        "user_id",
        "event_id",
        F.when(forged, "forged")
        .otherwise(F.coalesce("before", F.lit(integrity.GENESIS)))
        .alias("prev_hash"),
        F.when(edited, "edited").otherwise(F.col("own")).alias("entry_hash"),
        F.col("own").alias("expected_hash"),
    )
    return integrity.chain_breaks(sealed, ["user_id"], ["event_id"], sorted_before=True)


@query(
    "reconcile_counts",
    """WITH raw AS (SELECT l_orderkey % 100 AS tbl, count(*) AS n_raw FROM lineitem GROUP BY 1),
emitted AS (SELECT tbl, max(n) AS n_emitted FROM (
    SELECT l_orderkey % 100 AS tbl, l_returnflag AS domain, count(*) AS n FROM lineitem
    WHERE l_orderkey % 100 < 50 GROUP BY ALL
    UNION ALL SELECT l_orderkey % 100, 'all', count(*) FROM lineitem
    WHERE l_orderkey % 100 BETWEEN 10 AND 104 AND l_quantity <> 7 GROUP BY 1
    UNION ALL SELECT o_orderkey % 120, 'orders', count(*) FROM orders WHERE o_orderkey % 120 > 95 GROUP BY 1)
  GROUP BY 1)
SELECT tbl, coalesce(n_raw, 0) AS n_raw, coalesce(n_emitted, 0) AS n_emitted,
  CASE WHEN coalesce(n_raw, 0) = coalesce(n_emitted, 0) THEN 'complete'
    WHEN coalesce(n_raw, 0) > coalesce(n_emitted, 0) THEN 'rows missing' ELSE 'rows added' END AS verdict
FROM raw FULL JOIN emitted USING (tbl) WHERE tbl <> 5""",
)
def reconcile_counts(t: Tables) -> DataFrame:
    tbl = (F.col("l_orderkey") % 100).alias("tbl")
    raw = t("lineitem").select(tbl)
    by_flag = t("lineitem").select(tbl, F.col("l_returnflag").alias("domain")).where("tbl < 50")
    whole = t("lineitem").where("l_quantity <> 7").select(tbl, F.lit("all").alias("domain"))
    extra = t("orders").select(
        (F.col("o_orderkey") % 120).alias("tbl"), F.lit("orders").alias("domain")
    ).where("tbl > 95")
    emitted = by_flag.unionByName(whole.where("tbl BETWEEN 10 AND 104")).unionByName(extra)
    return quality.reconcile_counts(raw, emitted, ["tbl"], "domain", join_only=[5])


@query(
    "reconcile_fields",
    """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS c,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders
  WHERE o_orderkey % 3 <> 0)
SELECT count(*) AS n_compared, 'o_custkey' AS field, count(*) FILTER (c IS DISTINCT FROM o_custkey)
    AS n_mismatch FROM f JOIN orders USING (o_orderkey)
UNION ALL SELECT count(*), 'o_orderstatus', count(*) FILTER (s IS DISTINCT FROM o_orderstatus)
  FROM f JOIN orders USING (o_orderkey)
UNION ALL SELECT count(*), 'o_totalprice', count(*) FILTER (p IS DISTINCT FROM o_totalprice)
  FROM f JOIN orders USING (o_orderkey)""",
)
def reconcile_fields(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    columns = ["o_custkey", "o_orderstatus", "o_totalprice"]
    found = t("orders").where("o_orderkey % 3 <> 0").select(
        "o_orderkey",
        F.when(n % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(n % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice",
    )
    return quality.reconcile_fields(t("orders"), found, ["o_orderkey"], columns)


@query(
    "enum_census",
    """SELECT 'indicator' AS field, CAST(o_orderkey % 4 AS VARCHAR) AS value, count(*) AS n,
  o_orderkey % 4 IN (1, 2) AS mapped FROM orders GROUP BY ALL
UNION ALL SELECT 'status', l_linenumber::VARCHAR, count(*), l_linenumber BETWEEN 1 AND 4
FROM lineitem GROUP BY ALL
UNION ALL SELECT 'category', l_returnflag, count(*), false FROM lineitem GROUP BY ALL""",
)
def enum_census(t: Tables) -> DataFrame:
    parts = [
        quality.enum_census(t("orders"), "indicator", F.col("o_orderkey") % 4, codes.TXN_INDICATOR),
        quality.enum_census(t("lineitem"), "status", F.col("l_linenumber"), codes.TXN_STATUS),
        quality.enum_census(t("lineitem"), "category", F.col("l_returnflag"), codes.TXN_CATEGORY),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "field_coverage",
    """SELECT 'c_custkey' AS field, count(c_custkey) AS n_filled, false AS shown FROM customer
UNION ALL SELECT 'c_name', count(*) FILTER (c_name <> ''), true FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), false FROM customer
UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal > 0), true FROM customer
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment <> 'MACHINERY'), false FROM customer
UNION ALL SELECT 'tags', count(*) FILTER (c_custkey % 2 = 0), true FROM customer""",
)
def field_coverage(t: Tables) -> DataFrame:
    tags = F.when(F.col("c_custkey") % 2 == 0, F.array("c_name")).otherwise(
        F.array().cast("array<string>")
    )
    rows = t("customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("c_mktsegment"),
        tags.alias("tags"),
    )
    return quality.field_coverage(rows, ["c_name", "c_acctbal", "tags"])


@query(
    "ledger_leak_checks",
    f"""WITH {SQL_LEDGER}, {SQL_EVENT_LEDGER}, merged AS (
  SELECT source_txn_id FROM ledger UNION ALL SELECT source_txn_id FROM event_ledger)
SELECT (SELECT count(*) FROM (SELECT source_txn_id FROM merged WHERE source_txn_id IS NOT NULL
    GROUP BY 1 HAVING count(*) > 1)) AS n_duplicate_ids,
  (SELECT count(*) FROM (SELECT source_txn_id FROM ledger INTERSECT SELECT source_txn_id
    FROM event_ledger WHERE source_txn_id IS NOT NULL)) AS n_in_both_sources,
  (SELECT count(*) FROM merged WHERE source_txn_id IS NULL) AS n_without_key""",
)
def ledger_leak_checks(t: Tables) -> DataFrame:
    """Checked on a plain concatenation, where the overlap shows up as duplicate ids."""
    primary = order_ledger(t).select("source_txn_id")
    second = event_ledger(t).select("source_txn_id")
    return quality.ledger_checks(primary, second, primary.unionByName(second), "source_txn_id")


@query(
    "source_coverage",
    """SELECT source, count(*) AS n_files, count(l.doc_id) AS n_read,
  round(count(l.doc_id) * 100.0 / count(*), 1) AS pct_read
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""",
)
def source_coverage(t: Tables) -> DataFrame:
    files = t("documents").select("doc_id", "source")
    return quality.source_coverage(files, t("labels"), ["source"], "doc_id")


@query(
    "attribution_nulls",
    """SELECT count(*) AS n_records, count(*) FILTER (id % 11 = 0) AS n_without_source,
  count(*) FILTER (id % 13 = 0) AS n_without_hash
FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT event_id FROM events)""",
)
def attribution_nulls(t: Tables) -> DataFrame:
    ids = t("orders").select(F.col("o_orderkey").alias("id")).unionByName(
        t("events").select(F.col("event_id").alias("id"))
    )
    n = F.col("id")
    rows = ids.select(
        provenance(
            F.when(n % 11 == 0, "").otherwise("a.db"),
            sha256=F.when(n % 13 != 0, F.sha2(n.cast("string"), 256)),
        ).alias("provenance")
    )
    return quality.attribution_gaps(rows)


@query(
    "failed_sources",
    """SELECT source, CASE WHEN max(n_chars) > 20000 THEN -1 ELSE count(*) END AS n_rows
FROM documents GROUP BY 1 HAVING max(n_chars) > 20000""",
)
def failed_sources(t: Tables) -> DataFrame:
    """Run log per document source; a source with an oversized text counts as failed."""
    log = t("documents").groupBy("source").agg(
        F.when(F.max("n_chars") > 20_000, F.lit(-1).cast("bigint"))
        .otherwise(F.count(F.lit(1)))
        .alias("n_rows")
    )
    return quality.failed_sources(log)


@query(
    "config_diff_defaults",
    """WITH defaults AS (SELECT p_type AS key, CAST(min(p_size) AS VARCHAR) AS default_value FROM part
  WHERE p_type <> 'SMALL' GROUP BY 1)
SELECT p_partkey, p_type, p_size,
  CASE WHEN key IS NOT NULL THEN CAST(p_size AS VARCHAR) <> default_value END AS is_changed_from_default
FROM part LEFT JOIN defaults ON key = p_type""",
)
def config_diff_defaults(t: Tables) -> DataFrame:
    """Part sizes against the smallest size of their type; one type has no default."""
    defaults = (
        t("part")
        .where("p_type <> 'SMALL'")
        .groupBy(F.col("p_type").alias("key"))
        .agg(F.min("p_size").cast("string").alias("default_value"))
    )
    rows = t("part").select("p_partkey", "p_type", "p_size", F.col("p_size").cast("string").alias("v"))
    return changed_from_default(rows, defaults, "p_type", "v").drop("v")


@query(
    "collect_ordered_lists",
    """WITH counted AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS n_items,
  string_agg(l_partkey || 'x' || n, ',' ORDER BY l_linenumber, l_partkey) AS parts
FROM counted GROUP BY 1""",
)
def collect_ordered_lists(t: Tables) -> DataFrame:
    """The ordered part list of each order. Repeats are counted before the list is made."""
    counted = t("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count(F.lit(1)).alias("n")
    )
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "n")))
    text = F.transform(items, lambda p: F.concat(p["l_partkey"], F.lit("x"), p["n"]))
    return counted.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(text, ",").alias("parts")
    )


@query(
    "set_operations",
    """SELECT 'both' AS op, * FROM (SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events)
UNION ALL SELECT 'orders only', * FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)
UNION ALL SELECT 'never seen', * FROM (SELECT c_custkey FROM customer EXCEPT
  (SELECT o_custkey FROM orders UNION SELECT user_id FROM events))""",
)
def set_operations(t: Tables) -> DataFrame:
    """Distinct ids first, then joins on unique keys: no hot id takes part in them."""
    orders = t("orders").select(F.col("o_custkey").alias("id")).distinct()
    events = t("events").select(F.col("user_id").alias("id")).distinct()
    customers = t("customer").select(F.col("c_custkey").alias("id")).distinct()
    parts = {
        "both": orders.intersect(events),
        "orders only": orders.subtract(events),
        "never seen": customers.subtract(orders.union(events)),
    }
    return reduce(
        DataFrame.unionByName, [df.select(F.lit(op).alias("op"), "id") for op, df in parts.items()]
    )


@query(
    "unrepresented_domains",
    """WITH rows AS (SELECT source AS domain, count(*) AS n FROM documents GROUP BY 1)
SELECT domain FROM rows WHERE domain <> 'src1' AND domain NOT IN
  (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
)
def unrepresented_domains(t: Tables) -> DataFrame:
    """Sources (but src1, which has no times) with rows that never reach the list of flagged documents."""
    counts = t("documents").groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    flagged = t("labels").where("toxic = 1").select("doc_id").distinct()
    seen = t("documents").join(flagged, "doc_id").select(F.col("source").alias("ref_domain"))
    return quality.unrepresented_domains(counts.where("domain <> 'src1'"), None, seen)
