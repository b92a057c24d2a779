"""Columns that are called as the operators' own, and ids that are null."""

import zlib

from ledgerloom.llm import linededup, mixing, urls
from ledgerloom.llm.common import crc_of_id


def test_clashing_columns(spark):
    rows = [(1, "a shared line here\nown", "s"), (2, "a shared line here", "t"), (None, "x", None)]
    own = ["doc", "row", "_url", "pattern", "base", "spans", "hash", "line", "h1"]
    docs = spark.createDataFrame([(*r, *own) for r in rows], "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in own))
    kept = linededup.dedup_lines(docs).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, "a shared line here\nown"), (2, ""), (None, "x")}
    assert all(r[c] == c for r in kept for c in own)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken, _, _ = mixing.mix_table(docs)
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(
        (tuple(r) for r in docs.collect() for t in taken.collect() if t.doc_id == r.doc_id for _ in range(t.copies)), key=str
    )
    pages = spark.createDataFrame([(1, "http://a.org/x", "_url")], "page_id bigint, url string, _url string")
    listed = spark.createDataFrame([("org/", "block")], "entry string, action string")
    assert [(r._url, r.verdict) for r in urls.filter_urls(pages, listed).collect()] == [("_url", "block")]


def test_checksum_of_a_null_id(spark):
    ids = spark.createDataFrame([(7,), (None,), (-1,)], "doc_id bigint")
    assert {r[0] for r in ids.select(crc_of_id("doc_id")).collect()} == {zlib.crc32(x) for x in (b"7", b"", b"-1")}
