"""Operators on small hand-made tables, hot keys included, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import components, entities, geo, integrity, ledger, masking, quality, records, skew
from ledgerloom.operators.filters import FilterSpec, spec_from_inputs
from ledgerloom.schemas import conform, provenance
from ledgerloom.sources import sinks
from ledgerloom.sources.files import settings


def people(spark, rows):
    df = spark.createDataFrame(
        [(i, n, p, v) for i, (n, p, v) in enumerate(rows)],
        "i bigint, name string, phone string, vpas array<string>",
    )
    df = df.withColumn("case_id", F.lit("c")).withColumn("provenance", provenance("f", "t", F.col("i")))
    return conform(df, "person")


def entity_names(spark, rows):
    none = conform(people(spark, []).select("case_id"), "transaction")
    messages = conform(people(spark, []).select("case_id"), "message")
    table = entities.entity_table(people(spark, rows), none, messages)
    return sorted(sorted(r.names) for r in table.collect())


def test_entity_chain_is_order_independent(spark):
    a, b, c = ("Rec A", "9000000001", []), ("Rec B", "9000000001", ["x@y"]), ("Rec C", None, ["x@y"])
    assert entity_names(spark, [a, b, c]) == entity_names(spark, [c, a, b]) == [["Rec A", "Rec B", "Rec C"]]


def test_entity_name_variants(spark):
    spellings = ["FoodCo", "Foodco", "QUICKEATS", "Quickeats", "Acme Foods Pvt Ltd", "Acme Foods Private Limited"]
    assert len(entity_names(spark, [(n, None, []) for n in spellings])) == 3
    assert len(entity_names(spark, [(n, None, []) for n in ("Alice", "Bob", "राम", "श्याम")])) == 4


def test_components_against_union_find(spark):
    rng = random.Random(7)
    keys = [(i, "k", str(rng.randrange(400))) for i in range(600)]
    keys += [(i, "hot", "x") for i in range(0, 600, 3)]  # one key holds a third of the records
    keys += [(i, "chain", str(i // 2)) for i in range(600, 700)]
    keys += [(i, "chain2", str((i + 1) // 2)) for i in range(600, 700)]  # a path of 100 records
    parent = {i: i for i in range(720)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owner = {}
    for i, kind, v in keys:
        j = owner.setdefault((kind, v), i)
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    df = spark.createDataFrame(keys, "id bigint, kind string, value string")
    nodes = spark.range(720).withColumnRenamed("id", "id")
    for limit in (components.PLAIN_EDGES, 0):  # plain joins, then the hot-key path
        components.PLAIN_EDGES, kept = limit, components.PLAIN_EDGES
        got = {r.id: r.component for r in components.label_records(nodes, df, "id", ["kind", "value"]).collect()}
        components.PLAIN_EDGES = kept
        assert got == {i: find(i) for i in range(720)}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(50)}"
        rows.append((key, i, rng.randrange(1000), rng.random()))
    return spark.createDataFrame(rows, "k string, id bigint, t bigint, v double").cache(), rows


@pytest.fixture(params=[1, 4, 64])
def partitions(spark, request):
    """Partitions that sorted tables have: one, some, and more than keys."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_previous_row_and_position_equal_one_window(skewed, partitions):
    df, rows = skewed
    got = skew.scan_in_order(df, ["k"], ["t", "id"], {"before": "v", "then": "t"}, position="n")
    assert got.columns == [*df.columns, "before", "then", "n"]
    assert (got.select(F.spark_partition_id()).distinct().count() > 1) == (partitions > 1)
    want, last, seen = {}, {}, {}
    for k, i, t, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = (*last.get(k, (None, None)), seen[k])
        last[k] = v, t
    assert {r.id: (r.before, r.then, r.n) for r in got.collect()} == want
    # what comes out is still in order: a second scan needs no sort
    again = skew.scan_in_order(got.select("k", "id", "n"), ["k"], ["t", "id"], {"m": "n"}, sorted_before=True)
    assert {r.id: r.m for r in again.collect()} == {i: n - 1 or None for i, (_, _, n) in want.items()}


def test_the_input_is_read_once(skewed):
    df, _ = skewed
    got = skew.scan_in_order(df, ["k"], ["t", "id"], {"before": "v"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "InMemoryTableScan" not in plan


def test_scan_over_keys_of_every_kind(spark, partitions):
    rows = [(None, 1, "a"), (None, 2, None), ("x", 1, None), ("x", 2, "b"), ("x", None, "c"), ("", 5, "d"), ("y", 1, "e"), ("y", 1, "e")]
    df = spark.createDataFrame(rows, "k string, i int, v string").withColumn("at", F.timestamp_seconds(F.col("i"))).withColumn("s", F.struct("v"))
    got = skew.scan_in_order(df, ["k"], ["i"], {"p": "v", "q": "at", "r": "s"}, position="n").collect()
    one = {(r.k, r.i): (r.p, r.q and r.q.second, r.r and r.r.v, r.n) for r in got if r.k != "y"}
    assert one == {
        (None, 1): (None, None, None, 1), (None, 2): ("a", 1, "a", 2), ("x", None): (None, None, None, 1), ("x", 1): ("c", None, "c", 2), ("x", 2): (None, 1, None, 3),
        ("", 5): (None, None, None, 1),
    }
    assert sorted((r.p, r.n) for r in got if r.k == "y" and r.p) == [("e", 2)]
    none = skew.scan_in_order(df.where("false"), ["k"], ["i"], {"p": "v"}, position="n")
    assert none.collect() == [] and none.columns[-2:] == ["p", "n"]


def test_rank_all(skewed):
    df, rows = skewed
    got = {r.id: r.n for r in skew.rank_all(df, ["t", "id"], "n").collect()}
    want = {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1)}
    assert got == want


def test_lookups_keep_every_row(spark, skewed, monkeypatch):
    df, rows = skewed
    dim = df.where("k <> 'k7'").groupBy("k").agg(F.count("*").alias("w"), F.min("id").alias("first"))
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    got = {r.id: r.first for r in skew.lookup_weighted(df, dim, ["k"], "w").collect()}
    plain = {r.id: r.first for r in df.join(dim, "k").collect()}
    assert got == plain
    holed = df.withColumn("k", F.when(F.col("id") % 5 != 0, F.col("k")))
    left = skew.lookup_weighted(holed, dim, ["k"], "w", "left")
    assert {r.id: r.first for r in left.collect()} == {
        i: plain.get(i) if i % 5 else None for i in range(3000)
    }
    salted = skew.lookup_salted(df, dim.drop("w"), ["k"], ["id"])
    assert {r.id: r.first for r in salted.collect()} == {i: plain.get(i) for i in range(3000)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_key_of_a_third_of_the_rows_is_cut(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_KEYS", 32)
    names = [("c", "hot" if i % 3 == 0 else None if i % 50 == 1 else f"n{i % 700}", i) for i in range(9000)]
    owners = [("c", "hot", j) for j in range(4)] + [("c", f"n{j}", j) for j in range(500)] + [("d", "hot", 9), ("c", None, 5)]
    left = spark.createDataFrame(names, "case_id string, value string, party int").repartition(5)
    right = spark.createDataFrame(owners, "case_id string, value string, component int")
    pairs = {}
    for c, v, o in owners:
        pairs.setdefault((c, v), []).append(o)
    want = sorted(
        ((i, o) for c, v, i in names for o in (pairs.get((c, v), []) if v else []) or ([None] if how == "left" else [])), key=str
    )
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.join_heavy(left, right, ["case_id", "value"], how)
        assert joined.columns == ["case_id", "value", "party", "component"]
        placed = joined.select("party", "component", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted(((r.party, r.component) for r in placed), key=str) == want
    sizes = [sum(r.p == p for r in placed) for p in {r.p for r in placed}]
    assert max(sizes) < 2.5 * len(placed) / 8  # the hot name alone makes more than half of the pairs


def test_both_sides_hot_meet_on_a_grid(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 8)
    left = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(90).select(F.when(F.col("id") < 30, 0).otherwise(F.col("id") + 80).alias("k"), F.col("id").alias("b"))
    got = skew.join_heavy(left, right, ["k"]).orderBy("a", "b").collect()
    assert got == left.join(right, "k").orderBy("a", "b").collect()
    assert skew.join_heavy(left.limit(0), right, ["k"]).count() == 0
    assert skew.join_heavy(left, right.limit(0), ["k"], "left").count() == 300


def test_one_name_on_a_third_of_the_parties(spark):
    rows = [(f"h{i}@x", "Same Name" if i % 3 == 0 else f"Name {i}", i) for i in range(600)]
    parties = spark.createDataFrame(rows, "vpa string, name string, txn_count int").select(
        F.lit("c").alias("case_id"), "*", F.lit(None).cast("string").alias("phone"), F.lower(F.regexp_replace("name", " ", "")).alias("name_key")
    )
    owners = spark.createDataFrame(
        [("c", "name", "samename", "E1"), ("c", "vpa", "h3@x", "E2"), ("c", "name", "name4", "E3")],
        "case_id string, kind string, value string, component string",
    )
    got = {r.vpa: r.component for r in entities.attribute(parties, owners).collect()}
    want = {v: "E2" if v == "h3@x" else "E1" if n == "Same Name" else "E3" if n == "Name 4" else None for v, n, _ in rows}
    assert got == {v: c for v, c in want.items() if c}


def test_value_sets_are_whole(spark):
    rows = [("big", f"v{i % 2000:04}") for i in range(6000)] + [("small", "b"), ("small", "a"), ("small", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: r.s for r in skew.value_sets(df, ["k"], "v", "s").collect()}
    assert got == {"small": ["a", "b"], "big": [f"v{i:04}" for i in range(2000)]}


def test_last_value_before_a_row_skips_nulls(spark, partitions):
    values = [None if 5 < i < 60 or i % 3 else i for i in range(100)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("j", 7, None)], "k string, i int, v int")
    got = skew.scan_in_order(df, ["k"], ["i"], {"p": "v"}, skip_nulls=True)
    want, last = {("j", 7): None}, None
    for i, v in enumerate(values):
        want["k", i], last = last, v if v is not None else last
    assert {(r.k, r.i): r.p for r in got.collect()} == want


def test_settings_take_the_last_entry_of_any_tag(spark):
    bodies = {
        "a": b'<?xml version="1.0"?><map><int name="k" value="1"/><string name="k">2</string><double name="d" value="0.5"/></map>',
        "b": b"<map><string name='k'>x</str",
        "c": "<map><string name='k'>\u00e9</string><string name=''>y</string><set name='s'><string>z</string></set></map>".encode(),
        "d": None,
    }
    files = spark.createDataFrame(list(bodies.items()), "path string, content binary")
    got = {(r.path, r.key): r.value for r in settings(files, ["path"]).collect()}
    assert got == {("a", "k"): "2", ("a", "d"): "0.5", ("c", "k"): "\u00e9", ("c", "s"): None}


def test_anti_known_keeps_keyless_rows(spark):
    a = spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "1"), ("c", None)], "case_id string, id string")
    known = spark.createDataFrame([("c", "1"), ("c", "1"), ("c", None)], "case_id string, id string")
    got = sorted(map(tuple, skew.anti_known(a, known, {"id": "id"}, ("case_id",)).collect()), key=str)
    assert got == [("c", "2"), ("c", None), ("d", "1")]


# ---- ledger rules ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "kind, status, rrn, mine, direction, settled",
    [
        ("TRANSFER", "SUCCESS", "1", True, "debit", True),
        ("TRANSFER", "SUCCESS", "1", False, "credit", True),
        ("UPI_REQUEST", "PENDING", None, True, None, False),
        ("UPI_REQUEST", "SUCCESS", None, True, None, True),  # reaches no total
        ("UPI_REQUEST", "completed", "9", True, "credit", True),
        ("UPI_REQUEST", "COMPLETED", "9", False, "debit", True),
        ("REQUEST_RESPONSE", "SUCCESS", "1", False, "credit", True),
        ("TRANSFER_FAILED", "SUCCESS", "1", False, "credit", False),
        ("DECLINED", "SUCCESS", "1", True, "debit", False),
        (None, None, None, None, "credit", False),
    ],
)
def test_direction_rules(spark, kind, status, rrn, mine, direction, settled):
    df = spark.createDataFrame([(kind, status, rrn, mine)], "k string, s string, r string, m boolean")
    got = df.select(ledger.chat_direction("k", "s", "r", F.col("m")), ledger.chat_settled("k", "s")).first()
    assert tuple(got) == (direction, settled)


# ---- filters -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def txn(spark):
    df = spark.createDataFrame(
        [("c", 50.0, "debit", True, "2024-05-12 13:00:00", "shop"), ("c", None, None, False, None, "None")],
        "case_id string, amount double, direction string, settled boolean, ts string, tag string",
    )
    return df.select(
        "*", F.col("ts").cast("timestamp").alias("timestamp"),
        provenance("databases/passbook.db").alias("provenance"),
    ).drop("ts")


@pytest.mark.parametrize(
    "spec, n",
    [
        (FilterSpec(), 2),
        (FilterSpec(text="SHOP"), 1),
        (FilterSpec(text="passbook"), 0),
        (FilterSpec(source_contains="PASSBOOK"), 2),
        (FilterSpec(date_to="2024-05-12"), 1),
        (FilterSpec(date_to="2024-05-11"), 0),
        (FilterSpec(date_from="not a date"), 1),
        (FilterSpec(amount_min=100), 1),
        (FilterSpec(amount_min=10, amount_max=60), 2),
        (FilterSpec(amount_min=10, skip_inapplicable=False), 1),
        (FilterSpec(direction="debit"), 1),
        (FilterSpec(direction="credit"), 0),
        (FilterSpec(field_equals={"settled": "yes"}), 1),
        (FilterSpec(field_equals={"settled": False}), 1),
        (FilterSpec(field_equals={"nosuch": "None"}), 0),
        (FilterSpec(field_equals={"direction": "None"}), 0),
        (FilterSpec(field_equals={"tag": "None"}), 1),
        (FilterSpec(origin="carved"), 0),
    ],
)
def test_filters(txn, spec, n):
    assert spec.apply(txn).count() == n


def test_inapplicable_filters_keep_rows(spark):
    config = spark.createDataFrame([("k", "v")], "key string, value string")
    for spec in (FilterSpec(amount_min=5), FilterSpec(direction="debit"), FilterSpec(date_from="2024-01-01")):
        assert spec.apply(config).count() == 1
        spec.skip_inapplicable = False
        assert spec.apply(config).count() == 0


def test_presets_round_trip():
    spec = FilterSpec(text="x", amount_min=5.0, direction="debit", date_to="2026-01-01")
    saved = json.loads(json.dumps(spec.to_dict()))
    assert FilterSpec.from_dict({**saved, "unknown": 1}) == spec
    spec, ignored = spec_from_inputs({"amount_min": "ten", "amount_max": "7", "date_to": "whenever"})
    assert spec.amount_max == 7.0 and spec.amount_min is None and len(ignored) == 2


def test_date_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-05-12 13:00:00")], "id int, s string")
    df.select("id", F.col("s").cast("timestamp_ntz").alias("timestamp")).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    plan = FilterSpec(date_from="2024-01-01").apply(read)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan


# ---- views, sinks, integrity -------------------------------------------------------------------


def test_search_matches_real_values_and_shows_masked(spark, txn):
    hits = records.global_search({"transaction": txn.withColumn("name", F.lit("Asha Rao"))}, "asha", masked=True)
    got = hits.collect()
    assert len(got) == 2 and all("Asha" not in r.summary for r in got)


def test_summary_uses_the_first_filled_group(spark):
    df = spark.createDataFrame([(None, "Hi"), (5.0, "Hi"), (None, None)], "amount double, title string")
    got = [r.s for r in df.select(records.summary_line("x", df.schema).alias("s")).collect()]
    assert got == ["Hi", "5.0", "x"]


def test_csv_and_json_exports(spark, tmp_path, txn):
    rows = txn.withColumn("timestamp", F.struct(F.lit("1").alias("raw"), F.lit("unix_ms").alias("epoch_type"),
                                                F.col("timestamp").alias("utc")))
    sinks.export(rows, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert {"timestamp.utc_iso", "prov.source_file", "prov.read_mode"} <= set(back.columns)
    sinks.export(rows.withColumn("name", F.lit("राम")), str(tmp_path / "json"), "json")
    line = json.loads(spark.read.text(str(tmp_path / "json")).first().value)
    assert list(line) == sorted(line) and line["name"] == "राम"
    with pytest.raises(ValueError):
        sinks.export(rows, str(tmp_path / "x"), "pdf")


def fixes(spark, points):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "i bigint, lat double, lon double")
    return df.select(
        F.lit("c").alias("case_id"), "lat", "lon", F.lit("signal").alias("source"),
        F.timestamp_seconds(F.col("i") + 1_700_000_000).alias("utc"),
        F.struct(F.lit("f").alias("source_file"), F.col("i").alias("rowid")).alias("seq"),
    )


def test_identical_fixes_are_not_a_journey(spark):
    kinds = lambda pts: [json.loads(r.value)["geometry"]["type"] for r in geo.geojson_features(fixes(spark, pts)).collect()]
    assert set(kinds([(12.0, 77.0)] * 11)) == {"Point"}
    moving = kinds([(12.0 + i, 77.0) for i in range(4)])
    assert moving.count("Point") == 4 and moving.count("LineString") == 3


def test_audit_log_verification(spark, tmp_path):
    import hashlib

    def seal(entries):
        prev, lines = "0" * 64, []
        for e in entries:
            e = {**e, "prev_hash": prev}
            prev = hashlib.sha256((prev + json.dumps(e, sort_keys=True, ensure_ascii=False)).encode()).hexdigest()
            lines.append(json.dumps({**e, "entry_hash": prev}, ensure_ascii=False))
        return lines

    lines = seal([{"action": "a", "n": i, "who": "é"} for i in range(5)])
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.log").write_text("\n".join(lines) + "\n", encoding="utf-8")
    assert integrity.verify_logs(spark, str(tmp_path / "good")).collect() == []
    bad = list(lines)
    bad[1] = bad[1].replace('"n": 1', '"n": 9')
    bad[3] = "not json"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.log").write_text("\n".join(bad), encoding="utf-8")
    reasons = sorted(r.reason for r in integrity.verify_logs(spark, str(tmp_path / "bad")).collect())
    assert reasons == ["entry_hash mismatch (edited?)", "not valid JSON", "prev_hash does not chain"]


def test_manifest_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", None)], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("e", None)], "path string, sha256 string")
    got = {r.path: r.status for r in integrity.manifest_diff(old, new, ["path"]).collect()}
    assert got == {"b": "changed", "c": "missing", "d": "added"}


def test_leak_gate_raises(spark):
    texts = spark.createDataFrame([("s", "call 9876543210"), ("w", "call 9876543210 or ACME-1")], "g string, t string")
    counts = quality.leak_counts(texts, ["g"], "t", ["ACME-1"], F.col("g") == "w")
    got = {r.g: (r.n_mobile, r.n_literal) for r in counts.collect()}
    assert got == {"s": (1, 0), "w": (0, 1)}
    with pytest.raises(ValueError):
        quality.assert_no_leaks(counts)


def test_grid_sort_puts_empty_first(spark):
    df = spark.createDataFrame([("b",), (None,), ("A",), ("",)], "c string")
    got = [r.c for r in df.orderBy(*records.sort_keys("c", df.schema), F.col("c")).collect()]
    assert got[2:] == ["A", "b"] and set(got[:2]) == {None, ""}


def test_grid_sort_puts_numbers_before_words_and_unread_times_by_their_raw_value(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), (None,), ("-1.5",), ("A",), ("1e3",)], "c string")
    assert [r.c for r in df.orderBy(*records.sort_keys("c", df.schema)).collect()] == [None, "-1.5", "9", "10", "1e3", "A", "b"]
    down = df.orderBy(*records.sort_keys("c", df.schema, descending=True))
    assert [r.c for r in down.collect()] == ["b", "A", "1e3", "10", "9", "-1.5", None]
    times = [("a", 200, "5"), ("b", None, "10"), ("c", None, "9"), ("d", None, None), ("e", 100, "7"), ("f", None, "soon")]
    t = spark.createDataFrame(times, "id string, s bigint, raw string").select("id", F.struct("raw", F.timestamp_seconds("s").alias("utc")).alias("t"))
    assert [r.id for r in t.orderBy(*records.sort_keys("t", t.schema)).collect()] == ["d", "c", "b", "e", "a", "f"]


def test_identifiers_are_placed_at_their_own_match(spark):
    from ledgerloom.operators.residual import harvest

    blobs = spark.createDataFrame([(1, "id 129876543210 or 9876543210"), (2, None)], "id long, t string")
    found = {(r.id, r.kind, r.value, r.byte_offset) for r in harvest(blobs, ["id"], "t").collect()}
    assert found == {(1, "rrn", "129876543210", 3), (1, "phone", "9876543210", 19)}


def test_large_and_small_amounts_are_plain_digits(spark):
    from ledgerloom.operators.timeline import _number

    values = [(1e7,), (12345678.5,), (0.0005,), (12.5,), (None,)]
    shown = [r.s for r in spark.createDataFrame(values, "x double").select(_number("x").alias("s")).collect()]
    assert shown == ["10000000.0", "12345678.5", "0.0005", "12.5", None]


def test_names_are_looked_up_only_where_an_anchor_may_start(spark):
    names = spark.createDataFrame([("Ada Lovelace",), ("Grace Hopper",), ("Bo]b^",), ("Zoë",)], "name string")
    rows = [(1, "met Ada Lovelace and Zoë\nthere"), (2, "aGrace Hopperb, Bo]b^-Zoë"), (3, "ada lovelace"), (4, ""), (5, None)]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    found = {r["id"]: r["known_names"] for r in masking.names_in_texts(texts, "id", "text", names).collect()}
    assert found == {1: ["Ada Lovelace", "Zoë"], 2: ["Grace Hopper", "Bo]b^", "Zoë"]}
    anchors = [r["gram"] for r in masking.name_anchors(names, []).collect()]
    pairs = masking._windows(F.col("text"), 6, "AG")
    windows = texts.select("id", F.explode(pairs).alias("gram")).collect()
    assert len(anchors) == 4 and {(r["id"], r["gram"]) for r in windows} == {(1, "Ada Lo"), (2, "Grace ")}
