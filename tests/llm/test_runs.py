"""Word runs against a plain scan of every period of every document."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import queries, runs
from ledgerloom.llm.runs import Extension, find_runs, word_runs


def plain(words, shortest=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, yes in enumerate(same):
            if yes and start is None:
                start = i
            if not yes and start is not None:
                if i - start + q >= max(shortest, 2 * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted(([s, e - s, q] for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(pick):
    n, k = pick.choice([0, 1, 11, 12, 13, 30, 90, 200]), pick.choice([1, 2, 3, 40])
    words = [str(pick.randrange(k)) for _ in range(n)]
    if n > 20 and pick.random() < 0.7:
        a, p = pick.randrange(n), pick.randint(1, n // 3)
        for i in range(a + p, n):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_against_plain(seed, monkeypatch):
    pick = random.Random(seed)
    monkeypatch.setattr(runs, "WORDS", pick.choice([1, 100, 1 << 18]))
    monkeypatch.setattr(runs, "PAIRS", pick.choice([1, 50, 1 << 21]))
    docs = [some_words(pick) for _ in range(pick.randint(1, 8))]
    got = list(runs._documents([" ".join(d) for d in docs], 12))
    want = [plain(d) for d in docs]
    assert [g[1] for g in got] == want
    assert [g[2] for g in got] == [kept(d, w) for d, w in zip(docs, want, strict=True)]


def test_extensions():
    ids = np.random.default_rng(0).integers(0, 2, 500)
    ids[200:400] = ids[100:300]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(501), np.arange(501)))
    i, j = i[i != j], j[i != j]
    got = Extension(ids)(i, j)
    for a, b, g in zip(i[::37].tolist(), j[::37].tolist(), got[::37].tolist(), strict=True):
        n = 0
        while max(a, b) + n < 500 and ids[a + n] == ids[b + n]:
            n += 1
        assert g == n


def test_long_and_fully_periodic():
    assert find_runs(np.zeros(50_000, dtype=np.int64), np.array([50_000])).tolist() == [[0, 0, 50_000, 1]]
    assert find_runs(np.arange(90_000) % 4_000, np.array([90_000])).tolist() == [[0, 0, 90_000, 4_000]]


def test_rows_of_every_kind(spark):
    rows = [(1, "a b " * 8, "x", 1), (1, "a b " * 8, "x", 1), (2, None, "x", 1), (3, "", "x", 1), (None, "é x \x1cy " * 6, "x", 1), (4, "w " * 11, "x", 1), (5, "w\t\n" * 12, "x", 1)]
    got = word_runs(spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int"))
    assert got.columns == ["doc_id", "text", "runs", "n_words"]
    found = {(r.doc_id, r.text, r.runs.n_words, tuple(tuple(x) for x in r.runs.runs), r.runs.kept) for r in got.collect()}
    assert found == {
        (1, "a b " * 8, 16, ((0, 16, 2),), "a b"), (2, None, 0, (), ""), (3, "", 0, (), ""), (None, "é x \x1cy " * 6, 12, ((0, 12, 2),), "é x \x1cy"),
        (4, "w " * 11, 11, (), " ".join("w" * 11)), (5, "w\t\n" * 12, 12, ((0, 12, 1),), "w"),
    }
    assert got.count() == len(rows)
    assert word_runs(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for d, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = plain(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        want.add((d, len(found), *four, sha(lines), sha(kept(words, found))))
    got = queries.QUERIES["op12_word_runs"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == want
    assert all(t == "bigint" for c, t in got.dtypes if not c.endswith("sha256"))
