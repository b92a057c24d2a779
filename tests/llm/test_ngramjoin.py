"""The n-gram Jaccard join against all pairs in plain Python."""

import random

import numpy as np
import pytest

from ledgerloom.llm import ngramjoin as J


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, groups=12, copies=8, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))] + (passage if g % 2 else [])
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    long = " ".join(rng.choice(vocabulary) for _ in range(5000))
    rows += [(len(rows), long), (len(rows) + 1, long.upper() + " end")]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "One"), (len(rows) + 3, "one"), (None, "one"), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_all_links_are_found(spark, n, num, den):
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = J.ngram_classes(docs, n, num, den).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, n, num, den)


@pytest.mark.parametrize("region", [3000, 400])
def test_large_regions_are_split_exactly(spark, monkeypatch, region):
    monkeypatch.setattr(J, "REGION", region)
    rows = corpus(9, groups=6, copies=20)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = J.ngram_classes(docs, 5, 80, 100).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 5, 80, 100)


def test_large_regions_are_not_copied_many_times(spark, monkeypatch):
    # one region: a passage that all hold, and groups of near copies that are far from one another
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for g in range(6):
        own = [f"g{g}w{i}" for i in range(20)]
        for _ in range(8):
            text = own + passage
            text[rng.randrange(3)] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(text)))
    sets = [np.sort(J.shingle_set(t, 5).view(np.int64)) for _, t in rows]
    members = spark.createDataFrame([("r", f"{i:04d}", len(s), s.tolist()) for i, s in enumerate(sets)],
                                    "region string, node string, n bigint, elements array<bigint>").cache()
    whole, joined, join = sum(map(len, sets)), [], J._join_regions
    monkeypatch.setattr(J, "_join_regions", lambda rows, limit: (joined.append(rows.agg(J.F.sum("n")).first()[0] or 0), join(rows, limit))[1])
    monkeypatch.setattr(J, "REGION", 200)
    monkeypatch.setattr(J, "SLICE", 1000, raising=False)
    found = J._verified(members, J.Threshold(80, 100)).collect()
    least = {}
    for r in found:
        least.setdefault(r.component, set()).add(int(r.node))
    want = J.linked_classes([np.asarray(s) for s in sets], J.Threshold(80, 100))
    classes = {}
    for i, c in enumerate(want):
        classes.setdefault(c, set()).add(i)
    assert sorted(map(sorted, least.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)
    assert len(joined) > 2 and max(joined) <= 3 * whole


def test_rows_without_a_key_link(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(words)), (None, " ".join([*words, "x"])), (9, " ".join([*words, "x", "y"])), (None, "alone here and now it is")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = J.ngram_classes(docs, 5, 95, 100).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 5, 95, 100)


def _times(rows, width):
    batches = (J.pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i : i + width]], "node": [v for _, v in rows[i : i + width]]},
                                            schema=J.arrow_schema("key bigint, node bigint")) for i in range(0, len(rows), width))
    out = {}
    for batch in J._found_elsewhere(batches):
        for node, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out[node] = out.get(node, 0) + times
    return out


def test_elements_of_other_sets_are_counted_across_batches():
    rng = random.Random(3)
    rows = sorted(((rng.randint(0, 12), rng.choice([J.SEVERAL, -5, 3, 3, 8])) for _ in range(40)), key=lambda r: r[0])
    rows += [(20, 4), (20, 4), (20, 4), (21, 6), (22, 6), (22, J.SEVERAL), (23, 4), (23, 9)]
    want = {}
    for key, node in rows:
        if node != J.SEVERAL and any(k == key and v != node for k, v in rows):
            want[node] = want.get(node, 0) + 1
    for width in (1, 2, 3, 7, 100):
        assert _times(rows, width) == want


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_show_enough_common_elements(num):
    rng = np.random.default_rng(2)
    limit = J.Threshold(num, 100)
    for size in [*range(1, 60), 200, 777]:
        for _ in range(20):
            x = np.unique(J.mix64(rng.integers(0, 1 << 62, size).astype(np.uint64)))
            # the worst case: what differs comes first
            gone, new = rng.integers(0, len(x) // 5 + 1), rng.integers(0, size // 5 + 1)
            y = np.unique(np.concatenate([x[gone:], np.arange(new, dtype=np.uint64)]))
            inter = len(np.intersect1d(x, y))
            if limit.linked(inter, len(x) + len(y) - inter):
                common = len(np.intersect1d(x[: limit.shown(len(x))], y[: limit.shown(len(y))]))
                assert common >= max(limit.needed(len(x)), limit.needed(len(y)))


def test_empty_table(spark):
    assert J.ngram_classes(spark.createDataFrame([], "doc_id bigint, text string, source string")).collect() == []


def test_linked_sets_share_a_part_key():
    rng = np.random.default_rng(1)
    limit = J.Threshold(80, 100)
    for size in [*range(1, 60), 200, 777]:
        for _ in range(20):
            x = np.unique(J.mix64(rng.integers(0, 1 << 62, size).astype(np.uint64)))
            drop = rng.permutation(len(x))[: rng.integers(0, len(x) // 5 + 1)]
            y = np.unique(np.concatenate([np.delete(x, drop), J.mix64(rng.integers(0, 1 << 62, rng.integers(0, size // 5 + 1)).astype(np.uint64))]))
            inter = len(np.intersect1d(x, y))
            if limit.linked(inter, len(x) + len(y) - inter):
                assert len(np.intersect1d(J.part_keys(x, limit), J.part_keys(y, limit)))
