"""Hard negatives against a plain scan; the tree may only leave out what cannot matter."""

import numpy as np
import pytest

from ledgerloom.llm import negatives
from ledgerloom.llm.negatives import Tree, hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, leaf string, block string, anchor string"


def plain(rows, every=10, positives=5, most=10, low=30, high=90):
    one = {}
    for i, v, label in rows:
        if None not in (i, v, label) and len(v) and all(x is not None and np.isfinite(x) for x in v):
            one[i] = min(one.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in one.items():
        if a % every:
            continue
        scored = sorted((-float(np.dot(v, w)), i, k) for i, (k, w) in one.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            found = [(-t, i) for t, i, k in scored if k != label and low * -s <= 100 * -t <= high * -s][:most]
            out += [(a, p, n, i, -s, t) for n, (t, i) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(frame, anchors="id % 10 = 0", **kw).collect())


def vectors(n, seed, clusters=12):
    pick = np.random.default_rng(seed)
    middle = pick.integers(-60, 60, (clusters, 8))
    x = middle[pick.integers(0, clusters, n)] + pick.integers(-6, 7, (n, 8))
    x[: n // 3] = x[0]  # one vector of a third of the rows
    labels = pick.integers(0, 4, n)
    return [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]


def test_against_plain(spark, monkeypatch):
    rows = vectors(900, 1)
    want = plain(rows)
    assert len(want) > 1000
    assert found(spark, rows) == want
    for name, value in (("BLOCK", 100), ("GROUP", 20), ("FIT", 200), ("LEAF", 8), ("WAYS", 4)):
        monkeypatch.setattr(negatives, name, value)
    assert found(spark, rows) == want
    assert found(spark, rows, positives=2, negatives=3, low=50, high=100) == plain(rows, 10, 2, 3, 50, 100)


def test_rows_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 2) + [
        (100, None, 1), (110, [1.0] * 8, None), (None, [1.0] * 8, 1), (120, [nan] * 8, 1), (130, [inf] + [1.0] * 7, 2), (140, [None] + [1.0] * 7, 2), (150, [], 1),
        (160, [0.0] * 8, 1), (170, [5.0, 4.0], 1), (171, [5.0, 4.0], 1), (172, [2.0, 2.0], 2), (172, [2.0, 2.0], 2), (172, [2.0, 3.0], 3), (180, [9.0, 9.0, 9.0], 1), (-10, [60.0] * 8, 1),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(10, [1.0], 1)]) == []


@pytest.mark.parametrize("seed", range(5))
def test_the_tree_leaves_out_only_what_cannot_matter(seed):
    x = np.array([v for _, v, _ in vectors(2000, seed)])
    tree, ranges = Tree({8: x[::3]}), {}
    leaf = tree.place(x, ranges)
    tree.know(ranges)
    asked = x[::50]
    score = asked @ x.T
    low, high = np.quantile(score, 0.8, axis=1)[:, None], np.quantile(score, 0.95, axis=1)[:, None]
    met = tree.leaves(asked, low, high)
    inside = (score >= low) & (score <= high)
    for a in range(len(asked)):
        assert met[a, np.unique(leaf[inside[a]])].all()
    assert met.mean() < 0.8  # and on clustered vectors it does leave out
