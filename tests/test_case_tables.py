"""The SQLite data source: many cases, conditions and columns answered in the file, damage as rows."""

import os
import shutil
import sqlite3
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources import case_tables as module
from ledgerloom.sources import files as fs
from ledgerloom.sources import sqlite
from ledgerloom.sources.case_tables import CaseTablesReader, case_tables

CASES, USERS = 24, 2000


def database(path, users=USERS):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE users(id INTEGER PRIMARY KEY, Name TEXT, score REAL, pic BLOB, flag INTEGER, odd)")
    con.executemany(
        "INSERT INTO users VALUES (?, ?, ?, ?, ?, ?)",
        [(i, f"name {i} " * 20, i / 2, b"\x01\xff", i % 2, [None, 5, "five", 5.5, b"5", 1 << 40][i % 6]) for i in range(users)],
    )
    con.execute('CREATE TABLE "o""dd"(k TEXT PRIMARY KEY, name TEXT) WITHOUT ROWID')
    con.executemany('INSERT INTO "o""dd" VALUES (?, ?)', [(str(i), f"n{i}") for i in range(7)])
    con.execute("CREATE TABLE bare(x)")
    con.commit()
    con.close()


def splits_of(spark, root, out):
    sqlite.table_splits(sqlite.database_files(fs.file_inventory(fs.case_folders(spark, str(root))))).write.parquet(str(out))
    return str(out)


@pytest.fixture(scope="module")
def splits(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cases")
    for c in range(CASES):
        database(f"{root}/ev/c{c:02d}/databases/chat.db")
    folder = splits_of(spark, f"{root}/ev", root / "splits")
    # only what a query asks for may be opened: the file of this case is gone
    shutil.rmtree(f"{root}/ev/c05")
    return folder


def test_rows_of_all_cases(spark, splits):
    rows = case_tables(spark, splits)
    assert rows.schema.simpleString().endswith("row:map<string,string>,error:string>")
    counts = {(r.case_id, r.source_table): r["count"] for r in rows.where("error IS NULL").groupBy("case_id", "source_table").count().collect()}
    assert counts == {(f"c{c:02d}", t): n for c in range(CASES) if c != 5 for t, n in (("users", USERS), ('o"dd', 7))}
    gone = rows.where("error IS NOT NULL").collect()
    assert {(r.case_id, r.source_table) for r in gone} == {("c05", "users"), ("c05", 'o"dd')}
    one = rows.where("case_id = 'c03' AND source_table = 'users' AND rowid = 4").first()
    assert one.row == {"id": "4", "Name": "name 4 " * 20, "score": "2.0", "pic": "01ff", "flag": "0", "odd": "35"}
    assert one.read_mode == "immutable" and one.source_file == "databases/chat.db" and one.file_name == "chat.db"


def test_conditions_are_answered_while_reading(spark, splits):
    ddl = "case_id string, source_table string, rowid bigint, name string, score double, pic binary, flag boolean, odd bigint, missing string"
    rows = case_tables(spark, splits, ddl)
    asked = rows.where("source_table = 'users' AND rowid > 9 AND rowid <= 12 AND case_id IN ('c01', 'c02', 'c30')")
    plan = asked._jdf.queryExecution().executedPlan().toString() + asked._jdf.queryExecution().explainString(asked.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(source_table,users)" in plan and "GreaterThan(rowid,9)" in plan and "LessThanOrEqual(rowid,12)" in plan and "In(case_id" in plan
    got = sorted(tuple(r) for r in asked.collect())
    assert got == sorted(
        (c, "users", i, f"name {i} " * 20, i / 2, b"\x01\xff", bool(i % 2), {0: None, 1: 5, 5: 1 << 40}.get(i % 6), None)
        for c in ("c01", "c02") for i in (10, 11, 12)
    )
    # a table without rowids meets no bound; other conditions stay with Spark
    assert rows.where("source_table = 'o\"dd' AND rowid >= 0 AND case_id = 'c01'").count() == 0
    assert rows.where("source_table = 'o\"dd' AND case_id = 'c01' AND name LIKE '%3'").collect()[0].name == "n3"
    assert rows.where("case_id = 'c05' AND rowid = 1 AND rowid = 2").count() == 0


def reader(splits, ddl, spark):
    return CaseTablesReader(splits, spark.createDataFrame([], ddl).schema)


def test_a_task_opens_a_file_once(spark, splits, monkeypatch):
    opened, real = [], module._database

    @contextmanager
    def counted(root, path, with_log):
        opened.append(root)
        with real(root, path, with_log) as found:
            yield found

    monkeypatch.setattr(module, "_database", counted)
    r = reader(splits, "case_id string, rowid bigint, id bigint", spark)
    parts = r.partitions()
    assert sum(p.n for p in parts) == CASES * 2 and all(p.n <= module.TASK_RANGES for p in parts)
    n = sum(b.num_rows for p in parts for b in r.read(p))
    assert n == (CASES - 1) * (USERS + 7) + 2
    assert len(opened) <= CASES + len(parts)  # a file is only opened twice where two tasks share it
    opened.clear()
    assert list(r.pushFilters([module.ds.EqualTo(("case_id",), "c07"), module.ds.IsNotNull(("id",))])) == [module.ds.IsNotNull(("id",))]
    assert sum(b.num_rows for p in parts for b in r.read(p)) == USERS + 7
    assert len(opened) == 1


def test_types_that_tables_do_not_have(spark, splits):
    with pytest.raises(ValueError, match="columns of a type"):
        CaseTablesReader(splits, T.StructType([T.StructField("x", T.ArrayType(T.StringType()))]))


def test_damage_inside_a_range_is_a_row(spark, tmp_path):
    for c, at in (("a", 8), ("b", 100), ("c", None)):
        path = f"{tmp_path}/ev/{c}/x.db"
        database(path)
        body = bytearray(open(path, "rb").read())
        if at:
            body[40 * 4096 + at : 41 * 4096] = b"\xff" * (4096 - at)
        open(path, "wb").write(body)
    splits = splits_of(spark, f"{tmp_path}/ev", tmp_path / "splits")
    planned = {r.case_id for r in spark.read.parquet(splits).where("error IS NOT NULL").collect()}
    rows = case_tables(spark, splits)
    failed = {r.case_id for r in rows.where("error IS NOT NULL").collect()}
    # wrong rows without an error are found by the check of the whole file
    assert planned | failed == {"a", "b"} and planned == {"a", "b"}
    assert failed
    kept = rows.where("error IS NULL").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    for r in kept.collect():
        assert (r.n == USERS + 7) == (r.case_id == "c")
        if r.case_id == "b":  # only the rows of the damaged page are lost
            assert r.n > USERS - 30


def test_no_databases(spark, tmp_path):
    os.makedirs(f"{tmp_path}/ev/a")
    open(f"{tmp_path}/ev/a/x.db", "wb").close()
    splits = splits_of(spark, f"{tmp_path}/ev", tmp_path / "splits")
    assert case_tables(spark, splits).collect() == []
