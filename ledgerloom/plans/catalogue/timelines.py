"""Time and place queries."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.clocks import decode_epoch
from ...functions.text import json_text, to_bigint
from ...operators import analytics, geo, quality
from ...operators.skew import rank_all, scan_in_order
from ...operators.timeline import latest_activity, timeline_table
from ...schemas import provenance
from ...session import cut_lineage
from .base import Tables, number_top, query


def stamp(ts) -> F.Column:
    """A decoded-time struct around a stored timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.struct(
        c.cast("string").alias("raw"), F.lit("unix_ms").alias("epoch_type"),
        c.cast("timestamp").alias("utc"),
    ).alias("timestamp")


def domains(t: Tables) -> dict[str, DataFrame]:
    """Record domains over the tables: orders are transactions, events telemetry, line items
    appstate rows, conversation turns messages (every third one carries an amount)."""
    case = F.lit("case").alias("case_id")
    return {
        "transaction": t("orders").select(
            case,
            F.when(F.col("o_orderkey") % 2 == 0, "credit").alias("direction"),
            F.when(F.col("o_orderkey") % 7 != 0, F.floor("o_totalprice")).alias("amount"),
            F.concat(F.lit("C"), F.col("o_custkey")).alias("counterparty_name"),
            F.lit(None).cast("string").alias("counterparty_vpa"),
            stamp("o_orderdate"),
            provenance("orders", "orders", F.col("o_orderkey")).alias("provenance"),
        ),
        "diagnostic": t("events").select(
            case,
            F.col("event_type"),
            F.nullif(json_text("props", "$.k"), F.lit("0")).alias("app_version"),
            F.when(F.col("user_id") % 2 == 0, "wifi").alias("network_type"),
            stamp("ts"),
            provenance("events", "events", F.col("event_id")).alias("provenance"),
        ),
        "appstate": t("lineitem").select(
            case,
            F.col("l_returnflag").alias("key"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("value"),
            stamp(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))),
            provenance("lineitem", "lineitem", F.col("l_orderkey")).alias("provenance"),
        ),
        "message": t("conversations").select(
            case,
            F.col("role").alias("msg_type"),
            F.col("text").alias("content"),
            F.when(F.col("turn") % 3 == 0, F.lit(10.0)).alias("amount"),
            stamp(
                F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn"))
            ),
            provenance("conversations", "conversations", F.col("conv_id")).alias("provenance"),
        ),
    }


SQL_TIMELINE = """timeline AS (
  SELECT o_orderdate AS utc, 'transaction' AS ref_domain, o_orderkey AS rowid,
    trim(CASE WHEN o_orderkey % 2 = 0 THEN 'credit' ELSE '' END || ' ' ||
      CASE WHEN o_orderkey % 7 <> 0 AND floor(o_totalprice) <> 0
        THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.0' ELSE '' END ||
      ' C' || o_custkey) AS summary FROM orders WHERE o_orderdate IS NOT NULL
  UNION ALL
  SELECT ts, 'diagnostic', event_id, trim(event_type || ' v' ||
      coalesce(nullif(json_extract_string(props, '$.k'), '0'), 'None') || ' ' ||
      CASE WHEN user_id % 2 = 0 THEN 'wifi' ELSE '' END) FROM events WHERE ts IS NOT NULL
  UNION ALL
  SELECT l_shipdate, 'appstate', l_orderkey,
    l_returnflag || ': ' || l_orderkey || '-' || l_linenumber || '-' || l_partkey
  FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate IS NOT NULL
  UNION ALL
  SELECT make_timestamp((1700000000 + conv_id * 3600 + turn) * 1000000), 'message', conv_id,
    trim(role || ': ' || text, ' ') FROM conversations WHERE turn % 3 <> 0)"""


@query(
    "timeline_union",
    f"""WITH {SQL_TIMELINE}
SELECT utc, ref_domain, summary, row_number() OVER (ORDER BY utc, ref_domain, summary, rowid) AS seq
FROM timeline""",
)
def timeline_union(t: Tables) -> DataFrame:
    """The master timeline with the stored position of every event."""
    timeline = timeline_table(domains(t)).withColumn("rowid", F.col("provenance.rowid"))
    short = timeline.select("utc", "ref_domain", "summary", "rowid")
    ranked = rank_all(short, ["utc", "ref_domain", "summary", "rowid"], "seq")
    return ranked.select(F.col("utc").cast("timestamp_ntz").alias("utc"), "ref_domain", "summary", "seq")


@query(
    "timeline_latest12",
    f"""WITH {SQL_TIMELINE}, latest AS (SELECT * FROM timeline
  WHERE ref_domain NOT IN ('diagnostic', 'notification')
  ORDER BY utc DESC, ref_domain, summary LIMIT 12)
SELECT utc, ref_domain, summary, row_number() OVER (ORDER BY utc DESC, ref_domain, summary) AS rank
FROM latest""",
)
def timeline_latest12(t: Tables) -> DataFrame:
    latest = latest_activity(timeline_table(domains(t))).select("utc", "ref_domain", "summary")
    ranked = number_top(latest, [F.desc("utc"), "ref_domain", "summary"])
    return ranked.withColumn("utc", F.col("utc").cast("timestamp_ntz"))


@query(
    "activity_series",
    f"""WITH {SQL_TIMELINE}
SELECT utc, ref_domain, summary FROM timeline WHERE ref_domain IN ('transaction', 'diagnostic')""",
)
def activity_series(t: Tables) -> DataFrame:
    d = domains(t)
    timeline = timeline_table({k: d[k] for k in ("transaction", "diagnostic")})
    return analytics.activity_series(timeline).select(
        F.col("utc").cast("timestamp_ntz").alias("utc"), "ref_domain", "summary"
    )


@query(
    "timeline_completeness",
    """SELECT (SELECT count(*) FROM orders) AS n_ledger_rows,
  (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0) AS n_listed,
  (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey IN
    (SELECT event_id FROM events WHERE event_type = 'purchase')) AS n_repeated,
  (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS n_absent""",
)
def timeline_completeness(t: Tables) -> DataFrame:
    """A timeline with known faults: a fifth of the ledger missing, purchases listed again."""
    key = F.col("o_orderkey").alias("id")
    listed = t("orders").where("o_orderkey % 5 <> 0").select(key)
    again = t("events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    again = again.join(listed, "id", "left_semi")
    return quality.timeline_completeness(t("orders").select(key), listed.unionByName(again), "id")


@query(
    "timeline_inversions",
    """WITH shifted AS (SELECT user_id, event_id,
    CASE WHEN event_id % 10 = 0 THEN ts - INTERVAL 2 DAY ELSE ts END AS ts FROM events),
pairs AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM shifted)
SELECT user_id, count(*) AS n_rows, count(*) FILTER (before > ts) AS n_inversions
FROM pairs GROUP BY 1""",
)
def timeline_inversions(t: Tables) -> DataFrame:
    shifted = t("events").select(
        "user_id",
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.col("ts") - F.expr("INTERVAL 2 DAYS"))
        .otherwise(F.col("ts"))
        .alias("ts"),
    )
    return quality.inversions(shifted, ["user_id"], ["event_id"], "ts")


@query(
    "timestamp_decode",
    """WITH numbered AS (SELECT event_id, CASE event_id % 6
    WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR)
    WHEN 1 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR)
    WHEN 2 THEN CAST(epoch_us(ts) + 11644473600000000 AS VARCHAR)
    WHEN 3 THEN CAST(user_id AS VARCHAR) WHEN 4 THEN CAST(-event_id AS VARCHAR)
    ELSE event_type END AS raw, ts FROM events)
SELECT event_id, raw, CASE event_id % 6 WHEN 0 THEN 'unix_s' WHEN 1 THEN 'unix_ms'
    WHEN 2 THEN 'webkit_us' WHEN 3 THEN CASE WHEN raw = '0' THEN 'invalid' ELSE 'unknown' END
    WHEN 4 THEN 'invalid' END AS epoch_type,
  CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts)
    WHEN 2 THEN ts END AS utc
FROM numbered""",
)
def timestamp_decode(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    n = F.col("event_id") % 6
    raw = (
        F.when(n == 0, F.floor(micros / 1_000_000).cast("string"))
        .when(n == 1, F.floor(micros / 1_000).cast("string"))
        .when(n == 2, (micros + 11_644_473_600_000_000).cast("string"))
        .when(n == 3, F.col("user_id").cast("string"))
        .when(n == 4, (-F.col("event_id")).cast("string"))
        .otherwise(F.col("event_type"))
    )
    numbered = t("events").select("event_id", raw.alias("raw"))
    decoded = numbered.select("event_id", decode_epoch("raw").alias("t"))
    return decoded.select(
        "event_id", "t.raw", "t.epoch_type", F.col("t.utc").cast("timestamp_ntz").alias("utc")
    )


@query(
    "timestamp_census",
    """SELECT 'events.ts' AS field, 'unix_ms' AS epoch_type, count(*) AS n,
  min(date_trunc('millisecond', ts)) AS first_utc, max(date_trunc('millisecond', ts)) AS last_utc
FROM events
UNION ALL SELECT 'orders.o_orderdate', 'unix_ms', count(*), min(o_orderdate), max(o_orderdate) FROM orders
UNION ALL SELECT 'lineitem.l_shipdate', 'unix_ms', count(*), min(l_shipdate), max(l_shipdate)
FROM lineitem""",
)
def timestamp_census(t: Tables) -> DataFrame:
    def numbers(table: str, column: str, per_second: int) -> tuple[DataFrame, str]:
        micros = F.unix_micros(F.col(column).cast("timestamp"))
        value = F.floor(micros / (1_000_000 // per_second))
        return t(table).select(value.alias("n")).select(decode_epoch("n").alias("t")), "t"

    census = quality.timestamp_census(
        {
            "events.ts": numbers("events", "ts", 1000),
            "orders.o_orderdate": numbers("orders", "o_orderdate", 1000),
            "lineitem.l_shipdate": numbers("lineitem", "l_shipdate", 1000),
        }
    )
    return census.select(
        "field", "epoch_type", "n",
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_utc", "last_utc")],
    )


@query(
    "day_separators",
    """WITH pairs AS (SELECT event_id, user_id, ts,
    lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, CAST(ts AS DATE) AS day,
  before IS NULL OR CAST(before AS DATE) <> CAST(ts AS DATE) AS new_day FROM pairs""",
)
def day_separators(t: Tables) -> DataFrame:
    rows = scan_in_order(
        t("events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], {"before": "ts"}
    )
    return rows.select(
        "event_id",
        "user_id",
        F.to_date("ts").alias("day"),
        (F.col("before").isNull() | (F.to_date("before") != F.to_date("ts"))).alias("new_day"),
    )


# ---- places ------------------------------------------------------------------------------------


def evidence(t: Tables) -> DataFrame:
    """Fixes per user and per customer, from events (value, k) and from orders."""
    k = to_bigint(json_text("props", "$.k"))
    location = t("events").select(
        F.col("user_id").cast("string").alias("case_id"),
        F.round(F.col("value") % 90, 3).alias("latitude"),
        F.when(k % 10 != 0, k.cast("double")).alias("longitude"),
        F.col("event_type").alias("source_kind"),
        stamp("ts"),
        provenance("events", "events", F.col("event_id")).alias("provenance"),
    )
    diagnostic = t("orders").select(
        F.col("o_custkey").cast("string").alias("case_id"),
        (F.col("o_orderkey") % 90).cast("double").alias("latitude"),
        (F.col("o_orderkey") % 180).cast("double").alias("longitude"),
        stamp("o_orderdate"),
        provenance("orders", "orders", F.col("o_orderkey")).alias("provenance"),
    )
    return geo.fixes(location, diagnostic)


SQL_FIXES = """fixes AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, round(value % 90, 3) AS lat, CAST(k AS DOUBLE) AS lon,
    event_type AS source, ts AS utc, 'events' AS f, event_id AS r
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 10 <> 0
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), CAST(o_orderkey % 90 AS DOUBLE), CAST(o_orderkey % 180 AS DOUBLE),
    'diagnostic', o_orderdate, 'orders', o_orderkey FROM orders)"""


@query(
    "location_union_path",
    f"""WITH {SQL_FIXES}, steps AS (SELECT *,
    lag(lat) OVER w AS from_lat, lag(lon) OVER w AS from_lon FROM fixes
    WINDOW w AS (PARTITION BY case_id ORDER BY utc, f, r))
SELECT case_id, utc, source, from_lat, from_lon, lat, lon FROM steps WHERE from_lat IS NOT NULL""",
)
def location_union_path(t: Tables) -> DataFrame:
    steps = geo.path_segments(cut_lineage(evidence(t)), ["case_id"], ["utc", "seq"])
    return steps.select(
        "case_id", F.col("utc").cast("timestamp_ntz").alias("utc"), "source",
        "from_lat", "from_lon", "lat", "lon",
    )


@query(
    "distinct_positions",
    f"""WITH {SQL_FIXES}, per_case AS (SELECT case_id, count(*) AS n_fixes,
    count(DISTINCT (round(lat, 5), round(lon, 5))) AS n_positions FROM fixes GROUP BY 1)
SELECT *, n_fixes > 1 AND n_positions > 2 AS has_path FROM per_case""",
)
def distinct_positions(t: Tables) -> DataFrame:
    return geo.position_counts(evidence(t), ["case_id"]).withColumn("has_path", geo.has_path())


@query(
    "bounding_box",
    f"""WITH {SQL_FIXES}, kinds AS (SELECT source AS grp, lat, lon FROM fixes
    UNION ALL SELECT 'one point', lat, lon FROM fixes WHERE f = 'events' AND r = 1),
box AS (SELECT grp, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM kinds GROUP BY 1)
SELECT grp, CASE WHEN b - a < 0.02 THEN a - 0.01::DOUBLE ELSE a END AS min_lat,
  CASE WHEN b - a < 0.02 THEN b + 0.01::DOUBLE ELSE b END AS max_lat,
  CASE WHEN d - c < 0.02 THEN c - 0.01::DOUBLE ELSE c END AS min_lon,
  CASE WHEN d - c < 0.02 THEN d + 0.01::DOUBLE ELSE d END AS max_lon FROM box""",
)
def bounding_box(t: Tables) -> DataFrame:
    points = evidence(t)
    one = points.where("seq.source_file = 'events' AND seq.rowid = 1")
    groups = points.select(F.col("source").alias("grp"), "lat", "lon").unionByName(
        one.select(F.lit("one point").alias("grp"), "lat", "lon")
    )
    return geo.bounding_box(groups, ["grp"])


@query("events_per_kind", "SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1")
def events_per_kind(t: Tables) -> DataFrame:
    return t("events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pivot_latest_values",
    """WITH latest AS (SELECT user_id, CAST(ts AS DATE) AS day,
    max_by(value, event_id) FILTER (event_type = 'click') AS latitude,
    max_by(value, event_id) FILTER (event_type = 'view') AS longitude,
    max_by(props, event_id) FILTER (event_type = 'signup') AS pincode,
    max(event_id) FILTER (event_type = 'click') AS rowid
  FROM events GROUP BY 1, 2)
SELECT * FROM latest WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
)
def pivot_latest_values(t: Tables) -> DataFrame:
    def last(kind: str, value: str) -> F.Column:
        return F.max_by(value, F.when(F.col("event_type") == kind, F.col("event_id")))

    return (
        t("events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            last("click", "value").alias("latitude"),
            last("view", "value").alias("longitude"),
            last("signup", "props").alias("pincode"),
            last("click", "event_id").alias("rowid"),
        )
        .where("latitude IS NOT NULL AND longitude IS NOT NULL")
    )


@query(
    "geojson_features",
    f"""WITH {SQL_FIXES}, n AS (SELECT case_id, count(*) AS n_fixes,
    count(DISTINCT (round(lat, 5), round(lon, 5))) AS n_positions FROM fixes GROUP BY 1)
SELECT case_id, 'Point' AS kind, count(*) AS n_features, 0 AS n_positions FROM fixes GROUP BY 1
UNION ALL SELECT case_id, 'LineString', n_fixes - 1, n_positions FROM n
WHERE n_fixes > 1 AND n_positions > 2""",
)
def geojson_features(t: Tables) -> DataFrame:
    features = geo.geojson_features(evidence(t))
    kind = json_text("value", "$.geometry.type")
    places = json_text("value", "$.properties.distinct_positions").cast("bigint")
    return features.groupBy("case_id", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.coalesce(F.max(places), F.lit(0)).alias("n_positions"),
    )
