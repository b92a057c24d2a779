"""Ledger queries. Orders stand in for the primary ledger, events for payments seen elsewhere,
line items for instruments and customers for counterparties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import codes
from ...functions.chattext import payment_status, payment_verb
from ...functions.text import json_text, to_bigint
from ...operators import analytics
from ...operators.ledger import chat_direction, chat_settled, ledger_union, money_sum
from ...operators.skew import first_per_key
from .base import Tables, number_top, query, sql_money


def order_ledger(t: Tables) -> DataFrame:
    """Orders as ledger rows: indicator 0 has no label, about a third is settled."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return t("orders").select(
        F.col("o_orderkey").cast("string").alias("source_txn_id"),
        F.col("o_custkey"),
        F.col("o_totalprice").alias("amount"),
        codes.txn_direction(F.col("o_orderkey") % 3).alias("direction"),
        (F.col("o_orderstatus") == "F").alias("settled"),
        F.when(urgent, "chat").otherwise("passbook").alias("txn_source"),
        F.col("o_orderdate").alias("utc"),
    )


SQL_LEDGER = """ledger AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS source_txn_id, o_custkey, o_totalprice AS amount,
    CASE o_orderkey % 3 WHEN 1 THEN 'credit' WHEN 2 THEN 'debit' ELSE 'code:0' END AS direction,
    o_orderstatus = 'F' AS settled,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'chat' ELSE 'passbook' END AS txn_source,
    o_orderdate AS utc
  FROM orders)"""


@query(
    "financial_summary",
    f"""WITH {SQL_LEDGER}
SELECT count(*) AS n_txns,
  count(*) FILTER (txn_source = 'passbook') AS n_passbook,
  count(*) FILTER (txn_source = 'chat') AS n_chat,
  {sql_money('amount', "settled AND direction = 'credit'")} AS received,
  {sql_money('amount', "settled AND direction = 'debit'")} AS paid,
  count(*) FILTER (NOT settled OR direction IS NULL) AS n_excluded,
  {sql_money('amount', 'NOT settled OR direction IS NULL')} AS excluded_value
FROM ledger""",
)
def financial_summary(t: Tables) -> DataFrame:
    return analytics.financial_summary(order_ledger(t))


@query(
    "ledger_first_instrument",
    """WITH first_item AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1)
SELECT o_orderkey, o_totalprice, l_linenumber, l_partkey, l_suppkey
FROM orders LEFT JOIN first_item ON l_orderkey = o_orderkey""",
)
def ledger_first_instrument(t: Tables) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    first = first_per_key(t("lineitem"), ["l_orderkey"], order, order[:3])
    orders = t("orders").select("o_orderkey", "o_totalprice")
    return orders.join(first, orders.o_orderkey == first.l_orderkey, "left").drop("l_orderkey")


@query(
    "ledger_enum_decode",
    """WITH coded AS (
  SELECT o_orderkey % 3 AS indicator, CASE o_orderstatus WHEN 'F' THEN '2' WHEN 'O' THEN '1'
    WHEN 'P' THEN 'hold' END AS status, o_orderkey % 11 AS category FROM orders)
SELECT indicator, CASE indicator WHEN 1 THEN 'credit' WHEN 2 THEN 'debit'
    ELSE 'code:' || indicator END AS indicator_label,
  status, CASE status WHEN '1' THEN 'pending' WHEN '2' THEN 'success' ELSE 'code:' || status END
    AS status_label,
  category, CASE category WHEN 1 THEN 'food_and_beverages' WHEN 2 THEN 'money_in'
    WHEN 9 THEN 'cashback' ELSE 'code:' || category END AS category_label,
  count(*) AS n
FROM coded GROUP BY ALL""",
)
def ledger_enum_decode(t: Tables) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "F", "2")
        .when(F.col("o_orderstatus") == "O", "1")
        .when(F.col("o_orderstatus") == "P", "hold")
    )
    coded = t("orders").groupBy(
        (F.col("o_orderkey") % 3).alias("indicator"),
        status.alias("status"),
        (F.col("o_orderkey") % 11).alias("category"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return coded.select(
        "*",
        codes.txn_direction("indicator").alias("indicator_label"),
        codes.txn_status("status").alias("status_label"),
        codes.txn_category("category").alias("category_label"),
    )


def event_ledger(t: Tables) -> DataFrame:
    """Events as payments of a second source; every fiftieth one has no ledger key."""
    key = F.when(F.col("event_id") % 50 != 0, (F.col("event_id") * 3).cast("string"))
    return t("events").select(
        key.alias("source_txn_id"),
        F.col("value").alias("amount"),
        F.when(F.col("user_id") % 2 == 0, "debit").otherwise("credit").alias("direction"),
        (F.col("event_type") == "purchase").alias("settled"),
        F.lit("chat").alias("txn_source"),
    )


SQL_EVENT_LEDGER = """event_ledger AS (
  SELECT CASE WHEN event_id % 50 <> 0 THEN CAST(event_id * 3 AS VARCHAR) END AS source_txn_id,
    value AS amount, CASE WHEN user_id % 2 = 0 THEN 'debit' ELSE 'credit' END AS direction,
    event_type = 'purchase' AS settled, 'chat' AS txn_source
  FROM events)"""


@query(
    "ledger_union_anti",
    f"""WITH {SQL_LEDGER}, {SQL_EVENT_LEDGER}
SELECT source_txn_id, amount, direction, settled, 'passbook' AS txn_source FROM ledger
UNION ALL
SELECT source_txn_id, amount, direction, settled, txn_source FROM event_ledger e
WHERE source_txn_id IS NULL
  OR NOT EXISTS (SELECT 1 FROM ledger l WHERE l.source_txn_id = e.source_txn_id)""",
)
def ledger_union_anti(t: Tables) -> DataFrame:
    primary = order_ledger(t).select(
        "source_txn_id", "amount", "direction", "settled", F.lit("passbook").alias("txn_source")
    )
    return ledger_union(primary, event_ledger(t), scope=())


KINDS = {
    "purchase": "TRANSFER",
    "click": "UPI_REQUEST",
    "view": "REQUEST_RESPONSE",
    "signup": "TRANSFER_FAILED",
    "error": "DECLINED",
}
SQL_CHAT = """chat AS (
  SELECT event_id, user_id % 2 = 0 AS mine, k,
    CASE event_type WHEN 'purchase' THEN 'TRANSFER' WHEN 'click' THEN 'UPI_REQUEST'
      WHEN 'view' THEN 'REQUEST_RESPONSE' WHEN 'signup' THEN 'TRANSFER_FAILED'
      WHEN 'error' THEN 'DECLINED' END AS kind,
    CASE k % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'completed' WHEN 2 THEN 'PENDING' END AS status,
    CASE WHEN k % 3 <> 0 THEN '90' || lpad(CAST(event_id AS VARCHAR), 10, '0') END AS rrn,
    CASE WHEN k % 7 = 0 THEN 'request declined' ELSE 'sent you money' END AS content
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


@query(
    "ledger_direction_rules",
    f"""WITH {SQL_CHAT}, flags AS (SELECT *, contains(kind, 'REQUEST') AND NOT contains(kind, 'RESPONSE')
    AS request, coalesce(upper(status) IN ('SUCCESS', 'COMPLETED'), false) AS ok FROM chat),
marked AS (SELECT *, CASE WHEN contains(kind, 'FAIL') OR contains(content, 'fail') THEN 'failed'
    WHEN contains(content, 'declined') OR contains(kind, 'DECLINE') THEN 'declined'
    WHEN request THEN 'requested'
    WHEN contains(kind, 'TRANSFER') OR contains(content, 'approved') OR contains(kind, 'RESPONSE')
      THEN 'success' ELSE '' END AS payment_status FROM flags)
SELECT event_id, kind,
  CASE WHEN request AND NOT (ok AND rrn IS NOT NULL) THEN NULL
    WHEN request AND mine THEN 'credit' WHEN request THEN 'debit'
    WHEN mine THEN 'debit' ELSE 'credit' END AS direction,
  ok AND NOT contains(kind, 'FAIL') AND NOT contains(kind, 'DECLIN') AS settled,
  payment_status,
  CASE WHEN request THEN 'Payment requested'
    WHEN payment_status IN ('failed', 'declined') THEN 'Payment ' || payment_status
    WHEN mine THEN 'Sent' ELSE 'Received' END AS payment_verb
FROM marked""",
)
def ledger_direction_rules(t: Tables) -> DataFrame:
    k = to_bigint(json_text("props", "$.k"))
    kind = F.element_at(
        F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type")
    )
    chat = t("events").select(
        "event_id",
        (F.col("user_id") % 2 == 0).alias("mine"),
        kind.alias("kind"),
        F.when(k % 4 == 0, "SUCCESS")
        .when(k % 4 == 1, "completed")
        .when(k % 4 == 2, "PENDING")
        .alias("status"),
        F.when(
            k % 3 != 0,
            F.concat(F.lit("90"), F.lpad(F.col("event_id").cast("string"), 10, "0")),
        ).alias("rrn"),
        F.when(k % 7 == 0, "request declined").otherwise("sent you money").alias("content"),
    )
    return chat.select(
        "event_id",
        "kind",
        chat_direction("kind", "status", "rrn", F.col("mine")).alias("direction"),
        chat_settled("kind", "status").alias("settled"),
        payment_status("kind", "content").alias("payment_status"),
        payment_verb("kind", "content", F.col("mine")).alias("payment_verb"),
    )


SQL_CATEGORY = "nullif(c_mktsegment || ' ' || (c_nationkey % 4), 'MACHINERY 0')"


def categorised_ledger(t: Tables) -> DataFrame:
    """Settled totals per customer first, then the customer's category: the hot customers of a
    ledger are one row each before they meet another table."""
    per_customer = (
        order_ledger(t)
        .where("settled AND direction = 'debit'")
        .groupBy("o_custkey")
        .agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"))
    )
    segment = F.concat_ws(
        " ", "c_mktsegment", F.col("c_nationkey").cast("int") % 4
    )
    customers = t("customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.nullif(segment, F.lit("MACHINERY 0")).alias("category_label"),
    )
    return per_customer.join(customers, "o_custkey", "left").select(
        "category_label",
        F.col("amount").cast("double").alias("amount"),
        F.lit(True).alias("settled"),
        F.lit("debit").alias("direction"),
    )


@query(
    "spend_by_category_top8",
    f"""WITH {SQL_LEDGER}, spent AS (
  SELECT coalesce({SQL_CATEGORY}, 'uncategorised') AS category, {sql_money('amount')} AS spent
  FROM ledger LEFT JOIN customer ON c_custkey = o_custkey
  WHERE settled AND direction = 'debit' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
SELECT *, row_number() OVER (ORDER BY spent DESC, category) AS rank FROM spent""",
)
def spend_by_category_top8(t: Tables) -> DataFrame:
    top = analytics.spend_by_category(categorised_ledger(t))
    return number_top(top, [F.desc("spent"), "category"])


@query(
    "txns_per_month_last12",
    f"""WITH {SQL_LEDGER}
SELECT strftime(utc, '%Y-%m') AS month, count(*) AS n_txns FROM ledger
WHERE utc IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
)
def txns_per_month_last12(t: Tables) -> DataFrame:
    return analytics.txns_per_month(order_ledger(t), F.col("utc"))


def party_totals(t: Tables) -> DataFrame:
    return order_ledger(t).groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("txn_count"),
        money_sum("amount", F.col("settled") & (F.col("direction") == "credit")).alias(
            "total_received"
        ),
        money_sum("amount", F.col("settled") & (F.col("direction") == "debit")).alias("total_paid"),
    )


@query(
    "top_counterparties",
    f"""WITH {SQL_LEDGER}, totals AS (
  SELECT o_custkey AS entity_id, count(*) AS txn_count,
    {sql_money('amount', "settled AND direction = 'credit'")} AS total_received,
    {sql_money('amount', "settled AND direction = 'debit'")} AS total_paid
  FROM ledger GROUP BY 1),
top AS (SELECT *, row_number() OVER (ORDER BY txn_count DESC, entity_id) AS rank FROM totals
  WHERE entity_id <> 1)
SELECT top.*, c_name AS name FROM top LEFT JOIN customer ON c_custkey = entity_id WHERE rank <= 5""",
)
def top_counterparties(t: Tables) -> DataFrame:
    totals = party_totals(t).withColumn("is_subject", F.col("entity_id") == 1)
    top = number_top(
        analytics.top_counterparties(totals), [F.desc("txn_count"), "entity_id"]
    ).drop("is_subject")
    names = t("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    # five rows on the broadcast side
    return names.join(F.broadcast(top), "entity_id", "right")


@query(
    "report_analytics",
    f"""WITH {SQL_LEDGER}, cat AS (
  SELECT coalesce({SQL_CATEGORY}, 'uncategorised') AS label, {sql_money('amount')} AS value
  FROM ledger LEFT JOIN customer ON c_custkey = o_custkey
  WHERE settled AND direction = 'debit' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
mon AS (SELECT strftime(utc, '%Y-%m') AS label, CAST(count(*) AS DOUBLE) AS value FROM ledger
  GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
SELECT 'in_out' AS section, 'received' AS label,
  {sql_money('amount', "settled AND direction = 'credit'")} AS value FROM ledger
UNION ALL SELECT 'in_out', 'paid', {sql_money('amount', "settled AND direction = 'debit'")} FROM ledger
UNION ALL SELECT 'category', * FROM cat
UNION ALL SELECT 'month', * FROM mon""",
)
def report_analytics(t: Tables) -> DataFrame:
    money = analytics.financial_summary(order_ledger(t)).select(
        F.expr("stack(2, 'received', received, 'paid', paid) AS (label, value)")
    )
    category = analytics.spend_by_category(categorised_ledger(t))
    month = analytics.txns_per_month(order_ledger(t), F.col("utc"))
    return (
        money.select(F.lit("in_out").alias("section"), "label", "value")
        .unionByName(
            category.select(
                F.lit("category").alias("section"),
                F.col("category").alias("label"),
                F.col("spent").alias("value"),
            )
        )
        .unionByName(
            month.select(
                F.lit("month").alias("section"),
                F.col("month").alias("label"),
                F.col("n_txns").cast("double").alias("value"),
            )
        )
    )
