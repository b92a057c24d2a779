"""Suffix dedup against plain Python: every byte of a 50-byte string that an earlier document starts."""

import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import suffixdedup
from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.suffixdedup import COVER, V, dedup_spans

SCHEMA = "doc_id bigint, text string, chunk string, docs string, kept string"


def plain(rows, length=50):
    texts = [(1 << 63 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n_spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out.append((None if d == 1 << 63 else d, len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    got = [r.asDict() for r in dedup_spans(frame, **kw).collect()]
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append((t or "").encode())
    for r in got:  # the spans are the bytes that went
        if len(texts[r["doc_id"]]) == 1:
            body, at, kept = texts[r["doc_id"]][0], 0, b""
            for s, n in zip(r["starts"], r["lengths"], strict=True):
                kept, at = kept + body[at:s], s + n
            assert kept + body[at:] == r["kept"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)


def test_the_cover_meets_every_difference():
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    word = lambda: "".join(pick.choices("abcé", k=pick.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (9, 12, 14, 15, 16, 30, 200)]
    rows = []
    for d in range(120):
        parts = [pick.choice(passages) if pick.random() < 0.5 else word() * pick.randint(1, 40) for _ in range(pick.randint(0, 9))]
        rows.append((d * 7 % 121, pick.choice(["", " ", "\n"]).join(parts)))
    rows += [(500 + k, rows[5][1]) for k in range(40)]  # a group of exact copies
    rows += [(700 + k, rows[8][1] + str(k)) for k in range(40)]  # and of near copies
    rows += [(900, None), (901, ""), (None, rows[5][1]), (None, rows[8][1]), (5, rows[5][1]), (5, "x" * 49), (902, "x" * 50), (903, "x" * 50)]
    rows += [(904, "ab" * 3000), (905, "ba" * 2000), (906, "\0" * 70), (907, "\0" * 60 + "\1"), (908, passages[-1] * 60)]
    return rows


def test_against_plain(spark, rows, monkeypatch):
    want = plain(rows)
    assert found(spark, rows) == want
    monkeypatch.setattr(suffixdedup, "CHUNK", 3000)  # many chunks
    assert found(spark, rows) == want


def test_other_lengths(spark, rows):
    assert found(spark, rows, length=26) == plain(rows, 26)
    with pytest.raises(ValueError):
        found(spark, rows, length=25)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_blocks_are_suffix_classes():
    pick = np.random.default_rng(4)
    text = bytes(pick.integers(97, 99, 4000).astype(np.uint8))
    s = np.zeros(3000, dtype=suffixdedup._SAMPLE)
    at = pick.integers(12, 3900, 3000)
    for k, p in enumerate(at):
        body = text[p + 38 : p + 50]
        left = text[p - 12 : p][::-1]
        s[k] = (hash(text[p : p + 38]) & 0xFFFFFFFF, 0, *np.frombuffer(left[:8], ">u8"), *np.frombuffer(left[8:], ">u4"),
                *np.frombuffer(body[:8], ">u8"), *np.frombuffer(body[8:], ">u4"), pick.integers(0, 50), pick.integers(0, 13), pick.integers(38, 51))
    bits = suffixdedup.sorted_suffixes(s, 38, 50)
    for d in range(13):
        valid = [k for k in range(3000) if s["nl"][k] >= d and s["nr"][k] >= 50 - d]
        first = {}
        for k in valid:
            w = text[at[k] - d : at[k] - d + 50]
            first[w] = min(first.get(w, 99), int(s["doc"][k]))
        for k in valid:
            assert bool(bits[k] >> d & 1) == (s["doc"][k] > first[text[at[k] - d : at[k] - d + 50]])


def test_query_columns(spark):
    got = QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
