"""Filter, search, grid and conversation queries."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import conversations, records
from ...operators.filters import FilterSpec
from ...operators.skew import first_per_key, rank_all, scan_in_order
from ...schemas import provenance
from .base import Tables, number_top, query
from .timelines import stamp


def order_records(t: Tables) -> DataFrame:
    return t("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderkey") % 3 == 1, "credit")
        .when(F.col("o_orderkey") % 3 == 2, "debit")
        .alias("direction"),
        F.col("o_orderpriority").alias("tag"),
        (F.col("o_orderstatus") == "F").alias("settled"),
        F.col("o_orderdate").alias("timestamp"),
        F.struct(
            F.lit("live").alias("origin"),
            F.concat(F.lit("Books/"), F.col("o_orderstatus"), F.lit(".db")).alias("source_file"),
        ).alias("provenance"),
    )


SQL_ORDER_RECORDS = """records AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS amount,
    CASE o_orderkey % 3 WHEN 1 THEN 'credit' WHEN 2 THEN 'debit' END AS direction,
    o_orderpriority AS tag, o_orderstatus = 'F' AS settled, o_orderdate AS ts,
    'Books/' || o_orderstatus || '.db' AS source_file FROM orders)"""


@query(
    "filter_compound",
    f"""WITH {SQL_ORDER_RECORDS}
SELECT id, amount, direction, tag FROM records
WHERE contains(lower(concat_ws(chr(10), CAST(id AS VARCHAR), direction, tag)), 'high')
  AND ts >= TIMESTAMP '1996-03-01' AND ts <= TIMESTAMP '2000-09-30 23:59:59.999999'
  AND (amount IS NULL OR amount BETWEEN 20000 AND 400000)
  AND direction = 'debit' AND contains(lower(source_file), 'books/f') AND settled""",
)
def filter_compound(t: Tables) -> DataFrame:
    spec = FilterSpec(
        text="HIGH", date_from="1996-3-1", date_to="2000-09-30", origin="live",
        amount_min=20_000, amount_max=400_000, direction="debit", source_contains="BOOKS/f",
        field_equals={"settled": "true"},
    )
    return spec.apply(order_records(t)).select("id", "amount", "direction", "tag")


@query(
    "filter_date_inclusive",
    """SELECT event_id FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 23:59:59.999999'""",
)
def filter_date_inclusive(t: Tables) -> DataFrame:
    rows = t("events").select("event_id", F.col("ts").alias("timestamp"))
    spec = FilterSpec(date_from="05/01/2024", date_to="2024-01-12")
    return spec.apply(rows).select("event_id")


@query(
    "filter_inapplicable",
    f"""WITH {SQL_ORDER_RECORDS}
SELECT 'part' AS domain, p_partkey AS id FROM part
UNION ALL SELECT 'orders', id FROM records WHERE direction = 'credit'
  AND (amount IS NULL OR amount >= 100000) AND ts >= TIMESTAMP '1997-01-01'""",
)
def filter_inapplicable(t: Tables) -> DataFrame:
    """Parts have no amount, direction or time and pass; orders that have them are filtered."""
    spec = FilterSpec(direction="credit", amount_min=100_000, date_from="1997-01-01")
    part = spec.apply(t("part").select(F.col("p_partkey").alias("id"), "p_name"))
    orders = spec.apply(order_records(t))
    return part.select(F.lit("part").alias("domain"), "id").unionByName(
        orders.select(F.lit("orders").alias("domain"), "id")
    )


def searched(t: Tables) -> dict[str, DataFrame]:
    def rows(table: str, id_column: str, **fields: str) -> DataFrame:
        return t(table).select(
            F.lpad(F.col(id_column).cast("string"), 9, "0").alias("case_id"),
            *[F.col(c).alias(name) for name, c in fields.items()],
        )

    return {
        "customer": rows("customer", "c_custkey", name="c_name", person_type="c_mktsegment"),
        "document": rows("documents", "doc_id", content="text", chat_with="source"),
        "part": rows("part", "p_partkey", key="p_brand", value="p_name"),
        "supplier": rows("supplier", "s_suppkey", name="s_name"),
    }


@query(
    "global_search",
    """WITH hits AS (
  SELECT 'customer' AS domain, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key,
    left(c_name, 120) AS summary FROM customer
  WHERE contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1')
  UNION ALL SELECT 'document', lpad(CAST(doc_id AS VARCHAR), 9, '0'),
    left(concat_ws(' · ', nullif(text, ''), source), 120)
  FROM documents WHERE contains(lower(text), '1') OR contains(lower(source), '1')
  UNION ALL SELECT 'part', lpad(CAST(p_partkey AS VARCHAR), 9, '0'), p_brand || ' · ' || p_name
  FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), '1')
  UNION ALL SELECT 'supplier', lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), s_name FROM supplier
  WHERE contains(lower(s_name), '1'))
SELECT domain, '{"case_id":"' || key || '"}' AS record_key, summary,
  row_number() OVER (ORDER BY domain, key) AS rank FROM hits ORDER BY domain, key LIMIT 1000""",
)
def global_search(t: Tables) -> DataFrame:
    hits = records.global_search(searched(t), " 1 ", limit=1000)
    return number_top(hits, ["domain", "record_key"])


@query(
    "grid_sort_mixed",
    """WITH cells AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
    WHEN 2 THEN upper(event_type) WHEN 3 THEN CAST(event_id % 1500 - 20 AS VARCHAR) ELSE event_type END AS cell, value FROM events)
SELECT event_id, coalesce(cell, '') AS cell, value,
  row_number() OVER (ORDER BY CASE WHEN coalesce(cell, '') = '' THEN 0 WHEN TRY_CAST(cell AS DOUBLE) IS NOT NULL THEN 1 ELSE 2 END,
    TRY_CAST(cell AS DOUBLE) ASC NULLS FIRST, lower(nullif(cell, '')) ASC NULLS FIRST, value ASC NULLS FIRST, event_id) AS rank
FROM cells""",
)
def grid_sort_mixed(t: Tables) -> DataFrame:
    """A whole grid in display order: empty cells first, then numbers, then text without regard to case."""
    n = F.col("event_id") % 5
    cell = (
        F.when(n == 1, "")
        .when(n == 2, F.upper("event_type"))
        .when(n == 3, (F.col("event_id") % 1500 - 20).cast("string"))
        .when(n == 4, F.col("event_type"))
    )
    rows = t("events").select("event_id", cell.alias("cell"), "value")
    order = [
        *records.sort_keys("cell", rows.schema), *records.sort_keys("value", rows.schema), "event_id"
    ]
    return rank_all(rows, order, "rank").withColumn("cell", F.coalesce("cell", F.lit("")))


@query(
    "table_preview_cap",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  (SELECT count(*) FROM lineitem) - 500 AS more_rows
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500""",
)
def table_preview_cap(t: Tables) -> DataFrame:
    """A report shows the first 500 rows and says how many follow."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return records.preview(t("lineitem").select(*cols), cols, 500)


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    "domain_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS domain, count(*) AS n FROM {n}" for n in TABLES),
)
def domain_counts(t: Tables) -> DataFrame:
    return records.domain_counts({n: t(n) for n in TABLES})


def turns(t: Tables) -> DataFrame:
    """Conversation turns as chat messages of one case; 'user' is the owner of the device."""
    return t("conversations").select(
        F.lit("case").alias("case_id"),
        F.col("conv_id").alias("channel_url"),
        F.col("turn"),
        F.when((F.col("conv_id") % 4 == 0) & (F.col("role") == "assistant"), "Helper").alias(
            "chat_with"
        ),
        F.col("role").alias("sender_id"),
        F.col("role").alias("sender_name"),
        F.when(F.col("turn") % 2 == 0, "TRANSFER").otherwise("UPI_REQUEST").alias("msg_type"),
        F.col("text").alias("content"),
        F.when(F.col("turn") % 3 != 0, F.col("turn").cast("double")).alias("amount"),
        stamp(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 7 + F.col("turn") * 40_000)),
        provenance("conversations", "conversations", F.col("turn")).alias("provenance"),
    )


def owner(t: Tables) -> DataFrame:
    return t("region").where("r_regionkey = 0").select(
        F.lit("case").alias("case_id"), F.lit("user").alias("subject_id")
    )


SQL_TURNS = """turns AS (SELECT *, make_timestamp((1700000000 + conv_id * 7 + turn * 40000) * 1000000)
    AS utc, CASE WHEN conv_id % 4 = 0 AND role = 'assistant' THEN 'Helper' END AS chat_with
  FROM conversations)"""


@query(
    "conversation_threads",
    f"""WITH {SQL_TURNS}
SELECT conv_id AS channel_url, coalesce(min_by(chat_with, turn) FILTER (chat_with IS NOT NULL),
    min_by(role, turn) FILTER (role <> 'user'), 'Outgoing (merchant)') AS title,
  count(*) AS n_messages, min(utc) AS first_utc, max(utc) AS last_utc
FROM turns GROUP BY 1""",
)
def conversation_threads(t: Tables) -> DataFrame:
    return conversations.conversations(turns(t), owner(t)).select(
        "channel_url", "title", "n_messages",
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_utc", "last_utc")],
    )


@query(
    "conversation_view",
    f"""WITH {SQL_TURNS}, marked AS (SELECT *, lag(utc) OVER (PARTITION BY conv_id ORDER BY utc, turn)
    AS before, CASE WHEN turn % 2 = 0 THEN 'TRANSFER' ELSE 'UPI_REQUEST' END AS kind,
    lower(text) AS low FROM turns),
status AS (SELECT *, CASE WHEN contains(low, 'fail') THEN 'failed'
    WHEN contains(low, 'declined') THEN 'declined' WHEN kind = 'UPI_REQUEST' THEN 'requested'
    ELSE 'success' END AS payment_status FROM marked)
SELECT conv_id AS channel_url, turn, role = 'user' AS outgoing,
  before IS NULL OR CAST(before AS DATE) <> CAST(utc AS DATE) AS new_day, payment_status,
  CASE WHEN turn % 3 = 0 THEN NULL WHEN kind = 'UPI_REQUEST' THEN 'Payment requested'
    WHEN payment_status IN ('failed', 'declined') THEN 'Payment ' || payment_status
    WHEN role = 'user' THEN 'Sent' ELSE 'Received' END AS payment_verb
FROM status""",
)
def conversation_view(t: Tables) -> DataFrame:
    return conversations.thread(turns(t), owner(t)).select(
        "channel_url", "turn", "outgoing", "new_day", "payment_status", "payment_verb"
    )


@query(
    "conversation_order",
    """SELECT conv_id, turn, role,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position FROM conversations""",
)
def conversation_order(t: Tables) -> DataFrame:
    rows = t("conversations").select("conv_id", "turn", "role")
    return scan_in_order(rows, ["conv_id"], ["turn", "role"], position="position")


@query(
    "conversation_first_user",
    """SELECT conv_id, min_by(role, turn) AS first_role, min_by(text, turn) AS opening
FROM conversations WHERE role <> 'system' GROUP BY 1""",
)
def conversation_first_user(t: Tables) -> DataFrame:
    """First member of each channel who is not the excluded one."""
    rows = t("conversations").where("role <> 'system'").select(
        "conv_id", "turn", F.col("role").alias("first_role"), F.col("text").alias("opening")
    )
    return first_per_key(rows, ["conv_id"], ["turn"], ["first_role", "opening"])
