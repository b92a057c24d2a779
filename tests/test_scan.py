"""Block-wise scans give what one pass over the whole bytes gives, wherever blocks and segments end."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import residual
from ledgerloom.sources import files as fs
from ledgerloom.sources import scan

PRINTABLE = re.compile(rb"[\x20-\x7e]+")


def reader(body):
    asked = []

    def read(at, n):
        asked.append(n)
        return body[at : at + n]

    return read, asked


def some_bytes(pick, n):
    parts = []
    while sum(map(len, parts)) < n:
        parts.append(pick.choice([bytes(pick.choices(range(256), k=pick.randint(1, 6))), b"a1.b@okbank ", b"9876543210", b"x" * pick.randint(1, 300), b"\x00", b"UPI12345678ABC"]))
    return b"".join(parts)[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_across_blocks_and_segments(seed, monkeypatch):
    pick = random.Random(seed)
    monkeypatch.setattr(scan, "BLOCK", pick.choice([1, 2, 7, 64, 1 << 20]))
    body, step = some_bytes(pick, pick.choice([0, 1, 50, 700])), pick.choice([1, 5, 33, 10_000])
    for shortest in (1, 4, 9):
        want = [(m.start(), m.group()) for m in PRINTABLE.finditer(body) if len(m.group()) >= shortest]
        got = []
        for start in range(0, len(body), step):
            got += scan.runs(reader(body)[0], len(body), start, min(start + step, len(body)), scan.PRINTABLE, shortest)
        assert sorted(got) == want


@pytest.mark.parametrize("seed", range(30))
def test_identifiers_across_blocks_and_segments(seed, monkeypatch):
    pick = random.Random(seed)
    block = pick.choice([3, 50, 1 << 20])
    monkeypatch.setattr(scan, "BLOCK", block)
    monkeypatch.setattr(residual, "BLOCK", block)
    body, step = some_bytes(pick, 900), pick.choice([1, 40, 333, 10_000])
    text = body.decode("latin-1")
    want = sorted((k, m.group(), m.start()) for k, s in residual.RESIDUAL_SHAPES.items() for m in re.finditer(s, text))
    got = []
    for start in range(0, len(body), step):
        got += residual.identifiers(reader(body)[0], len(body), start, min(start + step, len(body)))
    assert sorted(got) == want


def entry(origin, key, value=None, lead=b"\x01", gap=b"\x02", tail=b"\x00"):
    return b"_" + origin + b"\x00" + lead + key + (b"" if value is None else gap + value) + tail


ORIGIN = b"https://" + b"o" * 122  # 130 characters
ENTRIES = [
    (ORIGIN, b"k" * 150, b"v" * 500), (b"http://a.b", b"short", b"vals"), (b"http://a.b", b"k\x20 k", None), (b"http://a.b/x?u=_https://c.d", b"key", b"next one"),
    (b"https://e.f", b"q", b"abc"), (b"https://e.f", b"only", b"w" * 3000),
]


@pytest.mark.parametrize("block", [1, 3, 100, 1 << 20])
def test_storage_entries_come_whole(block, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", block)
    body = b"\xff_http" + b"".join(entry(*e, lead=b"\x01" * (i % 2)) + b"\x03\x04\xff" for i, e in enumerate(ENTRIES)) + b"_https://cut"
    got = [e[1:] for e in scan.storage_entries(reader(body)[0], len(body), 0, len(body))]
    # an entry without a value of its own takes none from the next one
    values = [v if v is not None and len(v) >= 4 else None for _, _, v in ENTRIES]
    assert got == [(o.decode(), k.decode(), v and v.decode()) for (o, k, _), v in zip(ENTRIES, values, strict=True)]
    far = entry(b"http://a.b", b"k", b"value", gap=b"\x00" * 219) + entry(b"http://a.b", b"j", b"value", gap=b"\x00" * 220)
    assert [e[3] for e in scan.storage_entries(reader(far)[0], len(far), 0, len(far))] == ["value", None]
    touching = entry(b"http://a.b", b"k", b"abcd", tail=b"") + entry(b"http://c.d", b"j", b"efgh")
    assert [e[1:] for e in scan.storage_entries(reader(touching)[0], len(touching), 0, len(touching))] == [("http://a.b", "k", "abcd"), ("http://c.d", "j", "efgh")]


def test_only_open_entries_are_kept(monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 1000)
    body = (b"A" * 10_000 + entry(b"http://a.b", b"k", b"value")) * 3
    read, asked = reader(body)
    assert [e[1:] for e in scan.storage_entries(read, len(body), 0, len(body))] == [("http://a.b", "k", "value")] * 3
    assert max(asked) <= 1000


def test_large_files_are_scanned_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT", 1 << 16)
    folder = tmp_path / "case"
    folder.mkdir()
    body = bytearray(b"\x00" * 400_000)
    planted = {5: b"first.one@okbank", (1 << 16) - 4: b"9876543210", 3 * (1 << 16) - 1: b"second.one@okbank", 399_980: b"last.one@okbank"}
    for at, value in planted.items():
        body[at : at + len(value)] = value
    body[100_000:250_000] = b"Z" * 150_000  # a run over several segments
    (folder / "a.bin").write_bytes(body)
    (folder / "empty.bin").write_bytes(b"")
    files = fs.file_inventory(fs.single_case(spark, str(folder)))
    found = residual.harvest_files(files, ["case_id", "path"])
    assert {(r.path, r.value, r.byte_offset) for r in found.collect()} == {("a.bin", v.decode(), at) for at, v in planted.items() if not 100_000 <= at < 250_000}
    strings = scan.scan_files(files, ["path"], "offset bigint, value string", scan.printable(5))
    assert strings.where("length(value) = 150000").select("offset").collect()[0].offset == 100_000
    assert strings.select(F.spark_partition_id()).distinct().count() > 1
    whole = scan.scan_files(files, ["path"], "offset bigint, value string", scan.printable(5), whole=True)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, strings.collect()))


def test_cells(spark):
    cells = spark.createDataFrame([(1, b"\x00abcdef\x01", "x"), (2, None, "x"), (3, b"", "x")], "id int, content binary, value string")
    got = scan.scan_cells(cells, ["id"], "offset bigint, found string", lambda *a: scan.printable(5)(*a))
    assert [tuple(r) for r in got.collect()] == [(1, 1, "abcdef")]


def test_one_case_is_listed_by_many_tasks(spark, tmp_path):
    want = set()
    for a in range(12):
        for b in range(10):
            folder = tmp_path / "case" / f".d{a}" / f"_e{b}" / "f"
            folder.mkdir(parents=True)
            for c in range(5):
                (folder / f"x{c}").write_bytes(b"1" * c)
                want.add((f".d{a}/_e{b}/f/x{c}", f"x{c}", c))
    (tmp_path / "case" / "top").write_bytes(b"")
    (tmp_path / "case" / "bare").mkdir()
    found = fs.file_inventory(fs.single_case(spark, str(tmp_path / "case")))
    assert {(r.path, r["name"], r["size"]) for r in found.collect()} == want | {("top", "top", 0)}
    assert found.schema.simpleString() == "struct<case_id:string,root:string,path:string,name:string,size:bigint>"
    assert found.select(F.spark_partition_id()).distinct().count() > 4
    assert fs.file_inventory(spark.createDataFrame([("a", str(tmp_path / "none"))], "case_id string, root string")).collect() == []
