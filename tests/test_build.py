"""The whole job over a made-up case, checked against hand-written facts."""

import os
import sqlite3

import fixture_case
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import quality
from ledgerloom.plans import build as build_module
from ledgerloom.plans.build import build
from ledgerloom.plans.normalisers.webfiles import CART_KEY
from ledgerloom.schemas import conform
from ledgerloom.sources import files as fs
from ledgerloom.sources import sqlite
from ledgerloom.sources.case_tables import case_tables
from ledgerloom.sources.sinks import read_domain, write_domain

JWT = fixture_case.JWT


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("evidence")
    fixture_case.build(str(root / "case1"))
    out = str(tmp_path_factory.mktemp("store"))
    defaults = spark.createDataFrame(
        [("maxAmount", "5"), ("same", "s")], "key string, default_value string"
    )
    build(spark, fs.case_folders(spark, str(root)), out, defaults)
    return out


def rows(spark, store, domain, *cols):
    df = read_domain(spark, store, domain)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_only_the_damaged_file_failed(spark, store):
    log = spark.read.parquet(f"{store}/_run_log")
    failed = quality.failed_sources(log).collect()
    assert [(r.normaliser.split("/")[-1], r.domain) for r in failed] == [("damaged.db", "source")]
    assert failed[0].error
    counts = {r.normaliser: r.n_rows for r in log.where("n_rows >= 0").collect()}
    expected = {
        "identity": 1, "transactions.passbook": 3, "transactions.chat": 3, "contacts.users": 1,
        "contacts.vpa_cache": 1, "chats.channels": 2, "chats": 5, "location.signal": 1,
        "location.pai_signal": 1, "location.cookie": 1, "consents": 2, "jobs": 2,
        "notifications": 2, "search.recent": 1, "state.storefront_flags": 2, "config.appmanager": 2,
        "config.bank": 3, "diagnostics.app": 2, "diagnostics.bank": 1, "prefs": 6,
        "encrypted.catalogue": 2, "webview.cookies": 5, "webview.cache": 1,
        "webview.localstorage": 1, "webview.indexeddb": 2, "webview.webdata": 1,
        "files.datastore": 1, "files.firebase_installation": 2, "files.remote_config": 2,
        "files.fb_events": 1, "capabilities": 4, "appstate.cart": 1, "crash.sessions": 1,
        "analytics.transport": 2, "contacts.db": 2, "state.reminders": 2, "sms.upload": 2,
        "notifications.in_app": 1, "identity.account": 2,
    }
    assert counts == expected


def test_passbook(spark, store):
    got = rows(
        spark, store, "transaction", "txn_id", "amount", "direction", "counterparty_name", "rrn",
        "counterparty_mobile", "account_bank", "account_branch", "instrument", "status_label",
        "category_label", "settled", "error_message", "txn_source", "timestamp.epoch_type",
    )
    book = {g[0]: g[1:] for g in got if g[-2] == "passbook"}
    assert book["T1"] == (
        76.0, "debit", "Tea Stall", "100000000009", "9812345678", "HDFC Bank", "009999", "HDFC Bank",
        "success", "food_and_beverages", True, None, "passbook", "unix_ms",
    )
    assert book["T2"][11].startswith("You have entered incorrect passcode")
    assert book["T3"][1] == "code:7" and book["T3"][2] is None and book["T3"][-1] == "invalid"


def test_chat_payments_follow_the_rules(spark, store):
    got = rows(
        spark, store, "transaction", "source_txn_id", "amount", "direction", "settled",
        "counterparty_name", "txn_source",
    )
    chat = {g[1]: g for g in got if g[-1] == "chat"}
    assert chat[20.0] == ("U1", 20.0, "credit", True, "Other Person", "chat")
    assert chat[45.0] == ("U2", 45.0, "credit", True, "Other Person", "chat")  # completed request
    assert chat[5.0] == (None, 5.0, None, False, "Me User", "chat")  # open request, unknown channel
    assert len(chat) == 3  # the payment the passbook also lists is not counted twice


def test_people(spark, store):
    got = {r.name: r for r in read_domain(spark, store, "person").collect()}
    me = got["Me User"]
    assert me.is_subject and me.customer_id == "CID-ME" and me.phone == "9999900000"
    assert me.account_age_text == "Since Jan 2020"
    assert got["Other Person"].account_age_text == "Since Jan 2020"
    assert got["Tea Stall"].person_type == "MERCHANT"
    assert got["Asha"].phone == "7111111111"
    assert got["Ravi"].phone == "7000000002" and got["Ravi"].vpas == ["ravi@ybl"]


def test_channels_and_messages(spark, store):
    got = rows(spark, store, "channel", "channel_url", "name", "member_count", "message_count",
               "timestamp.epoch_type")
    assert got == [("chan1", None, 2, 4, "unix_ms"), ("chan9", "Quiet", None, 0, "unix_ms")]
    amounts = rows(spark, store, "message", "content", "amount", "chat_with")
    assert ("hello there", None, "Other Person") in amounts
    assert ("req", 5.0, None) in amounts


def test_places(spark, store):
    got = rows(spark, store, "location", "source_kind", "latitude", "longitude", "pincode")
    assert got == [("cookie", 12.5, 77.5, "560001"), ("pai_signal", 1.2345, 6.789, None),
                   ("signal", 1.2345, 6.789, None)]


def test_jobs_keep_list_order(spark, store):
    got = rows(spark, store, "job", "worker_class", "job_names", "tags", "state_label")
    assert got == [("Plain", [], [], "code:9"),
                   ("com.acme.SmsWorker", ["sync", "again"], ["t1"], "ENQUEUED")]


def test_secrets_never_reach_a_table(spark, store):
    for domain in ("cookie", "pref", "config", "webcache", "appstate", "webstorage"):
        df = read_domain(spark, store, domain)
        texts = [F.col(c) for c in ("value", "body_preview", "detail") if c in df.columns]
        for r in df.select(F.concat_ws(" ", *texts).alias("t")).collect():
            assert JWT not in r.t and "SECRET-VALUE" not in r.t and "EAAsecret" not in r.t
    prefs = dict(rows(spark, store, "pref", "key", "value"))
    assert prefs["sso_token="] == "<redacted:12 chars>" and prefs["count"] == "3"
    assert prefs["AuthToken"] == "<redacted:3 chars>" and prefs["Fid"] == "f-1"
    config = {k: (v, c) for k, v, c in rows(spark, store, "config", "key", "value", "is_changed_from_default")}
    assert config["auth_token"][0] == "<redacted:5 chars>"
    assert config["maxAmount"][1] is True and config["same"][1] is False and config["other"][1] is None


def test_web_stores(spark, store):
    assert rows(spark, store, "webcache", "url", "method", "user_id") == [
        ("https://api.example/v1/me", "GET", "77")
    ]
    got = rows(spark, store, "webstorage", "origin", "key", "value", "store_kind")
    assert ("https://shop.example", "cartId", "cart-12345", "local_storage") in got
    assert ("https://shop.example", "000004.log", "another stored", "indexed_db") in got


def test_sealed_stores_are_only_catalogued(spark, store):
    got = rows(spark, store, "encrypted", "name", "owning_module")
    assert got == [("DataUPI.xml", "NPCI UPI security component"), ("cache1.json", "Vertical JSON cache")]


def test_serialized_files(spark, store):
    state = {k: (v, d) for k, v, d in rows(spark, store, "appstate", "key", "value", "detail")}
    assert state[CART_KEY][0] == "cart_id=9 count=2 items=2 customer_id=5 order_total=7"
    assert "<redacted:17 chars> | <redacted:15 chars> | event name" == state["facebook_sdk_queued_events"][1]
    crash = rows(spark, store, "crash", "session_id", "user_id", "preview", "start_time.epoch_type")
    assert crash == [("SID1", "U-7", "some keys", "unix_ms")]
    note = rows(spark, store, "notification", "title", "message", "deep_link")
    assert ("Offer", "Get 10", "app://z") in note


def test_capabilities(spark, store):
    got = rows(spark, store, "capability", "category", "name", "available")
    assert got == [
        ("Feature flag (remote config)", "autopay_on", True), ("Payment instrument", "Card", False),
        ("Payment instrument", "Wallet", True), ("Server API endpoint", "list", True),
    ]


def test_every_record_is_attributed(spark, store):
    for domain in ("transaction", "message", "person", "location", "cookie", "pref", "capability"):
        p = read_domain(spark, store, domain)
        assert p.where("provenance.source_file IS NULL OR provenance.ingest_sha256 IS NULL").count() == 0


def test_timeline(spark, store):
    t = read_domain(spark, store, "timeline")
    assert t.where("ref_domain = 'message'").count() == 1  # payments are listed as transactions
    assert t.where("ref_domain = 'notification'").count() == 1  # no bookkeeping rows
    stamps = [r.utc for r in t.collect()]
    assert stamps == sorted(stamps)


def test_entities(spark, store):
    e = {tuple(r.names): r for r in read_domain(spark, store, "entity").collect()}
    tea = e[("Tea Stall",)]
    assert (tea.txn_count, tea.total_paid, tea.vpas) == (1, 76.0, ["shop@okaxis"])
    other = e[("Other Person",)]
    assert (other.txn_count, other.total_received, other.msg_count) == (2, 65.0, 2)
    assert e[("Cashback",)].total_received == 50.0  # known from the ledger alone


def test_residual_identifiers(spark, store):
    got = rows(spark, store, "carved", "kind", "value", "provenance.origin")
    assert ("phone", "9777766666", "carved") in got and ("vpa", "gone@okaxis", "carved") in got
    assert not any(v == "shop@okaxis" for _, v, _ in got)  # live elsewhere


class Source:
    def __init__(self, domain, make):
        self.domain, self.make = domain, make

    def __call__(self, src):
        return conform(self.make(), self.domain)


def test_a_failing_source_loses_only_its_own_rows(spark, tmp_path, monkeypatch):
    one = spark.createDataFrame([("c", "q")], "case_id string, query string")

    def unplanned():
        raise ValueError("no such column")

    monkeypatch.setattr(build_module, "REGISTRY", {
        "good": Source("search", lambda: one),
        "bad": Source("search", lambda: one.withColumn("query", F.raise_error(F.lit("boom")).cast("string"))),
        "none": Source("search", lambda: one.limit(0)),
        "unplanned": Source("cookie", unplanned),
    })
    log = {r.normaliser: r for r in build_module.run_normalisers(spark, None, str(tmp_path)).collect()}
    assert {n: r.n_rows for n, r in log.items()} == {"good": 1, "bad": -1, "none": 0, "unplanned": -1}
    assert "boom" in log["bad"].error and "no such column" in log["unplanned"].error
    assert [r.query for r in read_domain(spark, str(tmp_path), "search").collect()] == ["q"]
    assert read_domain(spark, str(tmp_path), "cookie").count() == 0


def test_residual_scan_reads_write_ahead_logs(spark, tmp_path):
    folder = tmp_path / "cases" / "c" / "databases"
    os.makedirs(folder)
    con = sqlite3.connect(folder / "gone.db")
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("PRAGMA wal_autocheckpoint=0")
    con.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)")
    con.execute("INSERT INTO t VALUES (1, ' 9811122233 ')")
    con.commit()
    (folder / "note.txt").write_text("SQLite 9811122244")
    build(spark, fs.case_folders(spark, str(tmp_path / "cases")), str(tmp_path / "store"))
    got = read_domain(spark, str(tmp_path / "store"), "carved").select("value", "provenance.source_file").collect()
    con.close()
    assert ("9811122233", "databases/gone.db-wal") in {tuple(r) for r in got}
    assert {r.value for r in got} == {"9811122233"}


def test_rerun_does_not_duplicate(spark, store, tmp_path):
    table = read_domain(spark, store, "transaction")
    for _ in range(2):
        write_domain(table, str(tmp_path), "transaction")
    assert read_domain(spark, str(tmp_path), "transaction").count() == table.count() == 6


def table_rows(spark, databases, folder, ddl=None):
    sqlite.table_splits(databases).write.parquet(f"{folder}/splits")
    return case_tables(spark, f"{folder}/splits", ddl)


def test_write_ahead_log(spark, tmp_path):
    path = tmp_path / "c" / "databases" / "live.db"
    os.makedirs(path.parent)
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("PRAGMA wal_autocheckpoint=0")
    con.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(1, "a"), (2, "b")])
    con.commit()
    con.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, "new") for i in range(3, 8)])
    con.execute("DELETE FROM t WHERE id = 1")
    con.commit()
    inventory = fs.file_inventory(fs.single_case(spark, str(tmp_path / "c")))
    dbs = sqlite.database_files(inventory)
    got = table_rows(spark, dbs, tmp_path).collect()
    assert sorted(r.rowid for r in got) == [2, 3, 4, 5, 6, 7]
    assert {r.read_mode for r in got} == {"wal_applied"}
    delta = sqlite.log_deltas(dbs).collect()[0]
    assert (delta.n_before, delta.n_after, delta.net_hidden, delta.net_deleted) == (2, 6, 4, 0)
    con.close()


def test_large_table_is_read_in_ranges(spark, tmp_path, monkeypatch):
    path = tmp_path / "c" / "big.db"
    os.makedirs(path.parent)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i * 3, str(i)) for i in range(1000)])
    con.execute("CREATE TABLE w(k TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID")
    con.execute("INSERT INTO w VALUES ('a', 'b')")
    con.commit()
    splits = sqlite._table_splits(con)
    con.close()
    assert ("w", None, None, 1) in splits
    monkeypatch.setattr(sqlite, "SPLIT_ROWS", 100)
    con = sqlite3.connect(path)
    assert len([s for s in sqlite._table_splits(con) if s[0] == "t"]) == 10
    con.close()
    dbs = sqlite.database_files(fs.file_inventory(fs.single_case(spark, str(tmp_path / "c"))))
    assert table_rows(spark, dbs, tmp_path).count() == 1001
