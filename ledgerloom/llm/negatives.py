"""Hard-negative mining over a multiway hyperplane tree with distance ranges.

Each node of the tree has a few split points; a row goes to the child whose split point is nearest. For every
split point i and child j the node holds the range of distances from i to all rows below j. For an anchor whose
rows of interest have inner products in a window, these rows lie in an annulus around it: a child is left out
if, for any split point of its node, the ranges show that none of its rows is in the annulus. Rows of the
leaves left are compared exactly, so the result does not depend on the tree.

The split points come from a sample of ``FIT`` rows, so the tree is small and goes to all tasks; its ranges are taken
over all rows. Leaves are bundled, or cut, into blocks of about ``BLOCK`` rows, and anchors into groups of ``GROUP``; a
task compares one group with one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, written

FIT = 8192  #: rows of the sample that the split points are chosen from
WAYS = 12  #: split points of a node
LEAF = 32  #: sampled rows that are not split further
BLOCK = 8192  #: rows compared by a task
GROUP = 1024  #: anchors compared by a task

ROWS = "width int, leaf int, id bigint, label bigint, v binary"
RANGES = "node int, i int, j int, lo double, hi double"
ASKED = "block int, part int, anchor bigint, label bigint, v binary, leaves array<int>, ids array<bigint>, scores array<double>"
FOUND = "anchor bigint, wanted bigint, wanted_score double, id bigint, score double"


@dataclass
class Node:
    number: int
    points: np.ndarray
    children: list = field(default_factory=list)  # of Node, or the number of a leaf


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """Split points for vectors of each width, the ranges between them, and the bounds of the leaves."""

    def __init__(self, samples: dict[int, np.ndarray]):
        self.nodes, self.n_leaves = [], 0
        self.roots = {width: self._split(x) for width, x in sorted(samples.items())}

    def _split(self, x: np.ndarray):
        chosen = [0]  # far from each other, beginning with the first
        nearest = _distances(x, x[:1])[:, 0]
        while len(x) > LEAF and len(chosen) < WAYS and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _distances(x, x[chosen[-1:]])[:, 0])
        if len(chosen) == 1:
            self.n_leaves += 1
            return self.n_leaves - 1
        node = Node(len(self.nodes), x[chosen])
        self.nodes.append(node)
        home = _distances(x, node.points).argmin(axis=1)
        node.children = [self._split(x[home == j]) for j in range(len(chosen))]
        return node

    def place(self, x: np.ndarray, ranges: dict | None = None) -> np.ndarray:
        """The leaf of each row; the rows' distances widen ``ranges`` where given."""
        leaf = np.zeros(len(x), dtype=np.int32)
        stack = [(self.roots[x.shape[1]], np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not isinstance(node, Node):
                leaf[rows] = node
                if ranges is not None and len(rows):
                    square = (x[rows] ** 2).sum(axis=1)
                    _widen(ranges, (-1, node, 0), square.min(), square.max())
                continue
            d = _distances(x[rows], node.points)
            home = d.argmin(axis=1)
            for j, child in enumerate(node.children):
                own = home == j
                if own.any():
                    if ranges is not None:
                        for i in range(len(node.points)):
                            _widen(ranges, (node.number, i, j), d[own, i].min(), d[own, i].max())
                    stack.append((child, rows[own]))
        return leaf

    def know(self, ranges: dict) -> None:
        """Take the ranges over all rows; subtrees without rows stay without."""
        self.ranges = {}
        for node in self.nodes:
            lo, hi = np.full((2, len(node.points), len(node.points)), np.inf)
            for i in range(len(node.points)):
                for j in range(len(node.points)):
                    lo[i, j], hi[i, j] = ranges.get((node.number, i, j), (np.inf, -np.inf))
            self.ranges[node.number] = lo, hi
        self.norms = {n: ranges[-1, n, 0] for n in range(self.n_leaves) if (-1, n, 0) in ranges}

    def leaves(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """anchors x leaves: may the leaf hold a row whose inner product with the anchor is in one of the anchor's
        windows [low, high]? (``low``, ``high``: anchors x windows.)"""
        out = np.zeros((len(x), self.n_leaves), dtype=bool)
        square = (x * x).sum(axis=1)
        slack = 1e-9 * (1 + square.max(initial=0) + max((hi for _, hi in self.norms.values()), default=0))

        def meets(rows, near, far, least, most):
            # squared distance = |a|^2 + |x|^2 - 2 * inner product: the window is an annulus around the anchor
            inner = square[rows][:, None] + least - 2 * high[rows] - slack
            outer = square[rows][:, None] + most - 2 * low[rows] + slack
            return (((near**2)[:, None] <= outer) & ((far**2)[:, None] >= inner)).any(axis=1)

        def norms(node):
            if not isinstance(node, Node):
                return self.norms.get(node)
            below = [b for c in node.children if (b := norms(c))]
            return (min(b[0] for b in below), max(b[1] for b in below)) if below else None

        stack = [(self.roots.get(x.shape[1]), np.arange(len(x)), np.zeros(len(x)), np.full(len(x), np.inf))]
        while stack:
            node, rows, near, far = stack.pop()
            bound = norms(node) if node is not None else None
            if bound is None or not len(rows):
                continue
            if not isinstance(node, Node):
                out[rows, node] = meets(rows, near, far, *bound)
                continue
            d = _distances(x[rows], node.points)
            lo, hi = self.ranges[node.number]
            for j, child in enumerate(node.children):
                if (bound := norms(child)) is None:
                    continue
                gap = np.sqrt(slack)
                closer = np.maximum(near, np.maximum(lo[:, j] - d, d - hi[:, j]).max(axis=1) - gap)
                farther = np.minimum(far, (d + hi[:, j]).min(axis=1) + gap)
                alive = meets(rows, np.maximum(closer, 0), farther, *bound)
                stack.append((child, rows[alive], np.maximum(closer[alive], 0), farther[alive]))
        return out


def _widen(ranges: dict, key: tuple, lo: float, hi: float) -> None:
    a, b = ranges.get(key, (np.inf, -np.inf))
    ranges[key] = min(a, float(lo)), max(b, float(hi))


def _vectors(column) -> np.ndarray:
    """Rows of a binary column of doubles, all of one width."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def _by_width(batch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths):
        yield int(width), batch.take(pa.array(np.flatnonzero(widths == width)))


def labelled_vectors(table: DataFrame, key: str, vector: str | Column, label: str | Column) -> DataFrame:
    """(width, leaf, id, label, v) of the rows that take part, one per id; v are packed doubles."""
    v = F.col(vector) if isinstance(vector, str) else vector
    label = F.col(label) if isinstance(label, str) else label
    rows = table.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), v.cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = batch.column("v").flatten().to_numpy(), np.cumsum(batch.column("v").value_lengths().to_numpy())
            parts = [x.tobytes() for x in np.split(values, ends[:-1])] if len(ends) else []
            width = np.diff(ends, prepend=0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(width), pa.array(np.zeros(len(ends), dtype=np.int32)), batch.column("id"), batch.column("label"), pa.array(parts, pa.binary())],
                schema=arrow_schema(ROWS),
            )

    one = whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return one.mapInArrow(packed, ROWS)


def plant(rows: DataFrame) -> tuple[DataFrame, Tree]:
    """(rows with their leaf, the tree): split points from ``FIT`` rows in hash order, ranges over all rows."""
    sample = rows.select("width", "v").orderBy(F.xxhash64("id"), "id").limit(FIT).collect()
    by_width: dict[int, list] = {}
    for r in rows.groupBy("width").agg(F.min_by("v", "id").alias("v")).collect():  # a width the sample may miss
        by_width[r.width] = [np.frombuffer(r.v)]
    for r in sample:
        by_width[r.width].append(np.frombuffer(r.v))
    tree = Tree({w: np.stack(x) for w, x in by_width.items()})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _by_width(batch):
                leaf = pa.array(tree.place(_vectors(part.column("v"))))
                yield part.set_column(1, "leaf", leaf)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict = {}
        for batch in batches:
            for _, part in _by_width(batch):
                tree.place(_vectors(part.column("v")), ranges)
        if ranges:
            keys, bounds = zip(*ranges.items(), strict=True)
            columns = [*zip(*keys, strict=True), *zip(*bounds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(RANGES), strict=True)], schema=arrow_schema(RANGES))

    at_leaf, _ = written(rows.mapInArrow(placed, ROWS), "negativerows")
    ranges = at_leaf.select("width", "v").mapInArrow(measured, RANGES).groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    tree.know({(r.node, r.i, r.j): (r.lo, r.hi) for r in ranges.collect()})
    return at_leaf, tree


def _blocks(at_leaf: DataFrame) -> dict[int, tuple[int, int]]:
    """leaf -> (first block, number of blocks): small leaves share a block, a large one has several."""
    out, block, room = {}, -1, 0
    for r in at_leaf.groupBy("leaf").count().orderBy("leaf").collect():
        if r["count"] > BLOCK:
            n = -(-r["count"] // BLOCK)
            out[r["leaf"]] = (block + 1, n)
            block, room = block + n, 0
        else:
            if r["count"] > room:
                block, room = block + 1, BLOCK
            out[r["leaf"]] = (block, 1)
            room -= r["count"]
    return out


def _asking(asked: DataFrame, tree: Tree, blocks: dict, parts: int, own: bool = False) -> DataFrame:
    """One row for each anchor and block that holds a leaf which may have rows of interest; with ``own``, only the
    leaf that the anchor is in.

    ``asked``: (anchor, label, v, low array, high array, ids, scores), windows of inner products."""
    shape = arrow_schema(ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            by_size: dict[tuple, list] = {}
            for r in batch.to_pylist():
                by_size.setdefault((len(r["v"]), len(r["low"])), []).append(r)
            for group in by_size.values():
                x = np.stack([np.frombuffer(r["v"]) for r in group])
                if own:
                    met = [[leaf] for leaf in tree.place(x).tolist()]
                else:
                    bounds = (np.array([r[c] for r in group], float) for c in ("low", "high"))
                    met = [np.flatnonzero(leaves).tolist() for leaves in tree.leaves(x, *bounds)]
                for r, leaves in zip(group, met, strict=True):
                    jobs: dict[int, list] = {}
                    for leaf in leaves:
                        first, n = blocks[leaf]
                        for b in range(first, first + n):
                            jobs.setdefault(b, []).append(leaf)
                    rows += [(b, r["part"], r["anchor"], r["label"], r["v"], of, r["ids"], r["scores"]) for b, of in jobs.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    part = F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")
    return asked.withColumn("part", part).mapInArrow(run, ASKED)


def _scores(asked: pa.Table, rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Inner products of all anchors and rows of a block, by id; NaN where the tree left the leaf out."""
    rows = rows.take(pa.array(np.argsort(rows.column("id").to_numpy(), kind="stable")))
    x = np.full((asked.num_rows, rows.num_rows), np.nan)
    leaf, width = rows.column("leaf").to_numpy(), rows.column("width").to_numpy()
    v = rows.column("v").to_pylist()
    wanted = [set(w) for w in asked.column("leaves").to_pylist()]
    anchors = asked.column("v").to_pylist()
    for one in np.unique(leaf):
        at = np.flatnonzero(leaf == one)
        who = np.array([k for k, w in enumerate(wanted) if one in w and len(anchors[k]) == 8 * width[at[0]]], dtype=np.int64)
        if len(who):
            ours = np.frombuffer(b"".join(anchors[k] for k in who)).reshape(len(who), -1)
            x[np.ix_(who, at)] = ours @ np.frombuffer(b"".join(v[k] for k in at)).reshape(len(at), -1).T
    return x, rows.column("id").to_numpy(), rows.column("label").to_numpy()


def _compared(asked: DataFrame, at_leaf: DataFrame, blocks: dict, parts: int, pick) -> DataFrame:
    """``pick`` on every group of anchors and block: (anchor row, scores, ids, labels) -> rows of FOUND."""
    spark = asked.sparkSession
    of_leaf = spark.createDataFrame([(leaf, *b) for leaf, b in blocks.items()], "leaf int, first int, n int")
    cut = at_leaf.join(F.broadcast(of_leaf), "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).alias("block"), "width", "leaf", "id", "label", "v",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    shape = arrow_schema(FOUND)

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            x, ids, labels = _scores(asked, rows)
            for k, r in enumerate(asked.drop_columns(["v", "leaves"]).to_pylist()):
                out += pick(r, x[k], ids, labels)
        columns = zip(*out, strict=True) if out else [[]] * len(shape)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return asked.groupBy("block", "part").cogroup(cut.groupBy("block", "part")).applyInArrow(run, FOUND)


def _first(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores; of equal ones the smaller ids, as ``ids`` ascend."""
    if len(scores) > 4 * most:
        bar = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= bar)
        return at[np.argsort(-scores[at], kind="stable")][:most]
    return np.argsort(-scores, kind="stable")[:most]


def hard_negatives(
    table: DataFrame, key: str = "vec_id", vector: str | Column = "embedding", label: str | Column = "label",
    anchors: str = "id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's hard negatives.

    A score is the inner product with the anchor, in doubles; higher ones come first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of the same label; for each, its first ``negatives`` rows of
    another label are returned whose score lies between ``low`` and ``high`` per cent of the positive's.
    ``anchors`` is a condition on ``id``. Rows take part if id, label and vector are not null and the vector is not
    empty and all finite; zero vectors take part. Vectors of different widths are never compared. Of rows that
    repeat an id the one with the smallest (label, vector) takes part. Anchors without positives, and positives
    without negatives, give no rows; an empty table gives none. Other columns are not read.
    """
    at_leaf, tree = plant(labelled_vectors(table, key, vector, label))
    blocks = _blocks(at_leaf)
    chosen = at_leaf.where(anchors)
    parts = max(1, -(-chosen.count() // GROUP))

    def same(r, scores, ids, labels):
        at = np.flatnonzero((labels == r["label"]) & (ids != r["anchor"]) & ~np.isnan(scores))
        at = at[_first(scores[at], ids[at], positives)]
        return [(r["anchor"], None, None, i, s) for i, s in zip(ids[at].tolist(), scores[at].tolist(), strict=True)]

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")

    def first_positives(bar: Column, rows: DataFrame, own: bool) -> DataFrame:
        asked = rows.select(
            F.col("id").alias("anchor"), "label", "v", F.array(bar).alias("low"), F.array(F.lit(float("inf"))).alias("high"),
            F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<double>").alias("scores"),
        )
        found = _compared(_asking(asked, tree, blocks, parts, own), at_leaf, blocks, parts, same)
        return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)

    # an anchor's own leaf says how high the score of its last positive is at least
    own = first_positives(F.lit(float("-inf")), chosen, True).where(F.col("nth") == positives)
    bars = own.select(F.col("anchor").alias("id"), F.col("score").alias("bar"))
    first = first_positives(F.coalesce("bar", F.lit(float("-inf"))), chosen.join(bars, "id", "left"), False)
    pairs, _ = written(first.select("anchor", F.col("id").alias("positive"), "score", "nth"), "negativepairs")
    windows = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive", "score"))).alias("w"))
    second = chosen.join(windows, F.col("id") == F.col("anchor")).select(
        "anchor", "label", "v", F.transform("w", lambda p: p["score"] * low / 100).alias("low"), F.transform("w", lambda p: p["score"] * high / 100).alias("high"),
        F.col("w.positive").alias("ids"), F.col("w.score").alias("scores"),
    )

    def other(r, scores, ids, labels):
        out = []
        far = np.flatnonzero((labels != r["label"]) & ~np.isnan(scores))
        theirs, their_ids = scores[far], ids[far]
        for positive, score in zip(r["ids"], r["scores"], strict=True):
            at = np.flatnonzero((100 * theirs >= low * score) & (100 * theirs <= high * score))
            at = at[_first(theirs[at], their_ids[at], negatives)]
            out += [(r["anchor"], positive, score, i, s) for i, s in zip(their_ids[at].tolist(), theirs[at].tolist(), strict=True)]
        return out

    found = _compared(_asking(second, tree, blocks, parts), at_leaf, blocks, parts, other)
    order = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("wanted").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("wanted_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
