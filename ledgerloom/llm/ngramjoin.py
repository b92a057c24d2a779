"""N-gram Jaccard join: exact classes of linked documents.

Jaccard distance is a metric, and the join splits documents by pivots: a document goes to the Voronoi
region of its nearest pivot and, where it lies within twice the radius of the border, to the neighbours
too, region by region until each fits a task. Over a whole corpus pivots cannot tell documents
apart, since unrelated shingle sets are all at a distance near 1. So the regions begin as groups that
provably hold every link: sets cut into more parts than linked sets can differ in must share a part
(pigeonhole), and groups that share no part need not meet.

Most documents link with nothing, and one pass rules nearly all of them out before that. In any order
common to all sets, two sets with many common elements have so many of them among their first ones. A set
whose first elements are hardly found in others has no link, also where it shares a passage.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import arrow_schema, cut_lineage, drop_written, merge, mix64, release, word_hashes, written
from .urls import build_filter, probe_filter

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xD1342543DE82EF95)
GROWTH = 1.4  #: ratio of the largest set sizes of two levels
SALTS = 32  #: partitions tried before a set with too many empty parts joins the common one
REGION = 6_000_000  #: shingles that one task joins
PIVOTS = 16  #: pivots of a region that is split
SPREAD = 1.25  #: a split by pivots is made if its regions hold at most so many times the shingles, and none above half of them
SLICE = 100_000_000  #: shingles of pairs of blocks that are shuffled at a time, or twice the regions' own if that is more


@dataclass(frozen=True)
class Threshold:
    """Sets link when ``den * intersection >= num * union``."""

    num: int
    den: int

    def linked(self, inter: np.ndarray, union: np.ndarray) -> np.ndarray:
        return self.den * inter >= self.num * union

    def within(self, inter: np.ndarray, union: np.ndarray, radii: int) -> np.ndarray:
        """Distance at most ``radii`` times the linking distance."""
        return self.den * (union - inter) <= radii * (self.den - self.num) * union

    def differing(self, size: int) -> int:
        """Most elements by which linked sets of at most ``size`` elements differ."""
        return (self.den - self.num) * 2 * size // (self.den + self.num)

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """So many of a set's first elements, in any order common to all, meet those of each linked set."""
        return size - (self.num * size + self.den - 1) // self.den + 1

    def unshared(self, size: int) -> int:
        """Most elements of a set that a linked set lacks."""
        return size - -(-self.num * size // self.den)

    def shown(self, size: int) -> int:
        """How many of its first elements a set shows to the others."""
        spare = self.unshared(size)
        return min(size, spare + 1 + spare // 2)

    def needed(self, size: int) -> int:
        """How many elements that a set shows are shown by any set it links with.

        Of two sets that show k elements more than they can lack, the first k common ones are
        shown by both; the smaller set has the smaller k.
        """
        return 1 + self.unshared(-(-self.num * size // self.den)) // 2

    def partner(self, size: int) -> int:
        """Largest set that one of ``size`` elements can link with."""
        return size * self.den // self.num


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; A-Z are lower-cased. Fewer than n words are
    one shingle, no words none."""
    words = word_hashes((text or "").encode().lower())
    if not len(words):
        return words
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            total = total * _LEVEL + words[i : len(words) - width + 1 + i]
        return np.unique(mix64(total))


@functools.cache
def levels(limit: Threshold, size: int) -> list[tuple[int, int, int]]:
    """(level, parts, differing) of the levels that a set of ``size`` elements takes part in.

    A level bounds the set size; linked sets of at most that size differ in at most ``differing``
    elements. A set is in the level of its size and, if larger sets of the next level can link with it,
    in that too.
    """
    top, before, level = 1, 0, 0
    while limit.differing(top + 1) == 0:
        top += 1
    out = []
    while True:
        if size <= top:
            low = max(1, before * limit.num // limit.den)
            differing = limit.differing(top)
            parts = differing + 1
            if differing:  # room for parts that hold no element of the set
                parts += math.ceil(1.5 * parts * math.exp(-low / parts)) + 1
            out.append((level, parts, differing))
            if out[0][0] < level or limit.partner(size) <= top:
                return out
        before, level, top = top, level + 1, max(top + 1, math.ceil(top * GROWTH))


def part_keys(elements: np.ndarray, limit: Threshold) -> np.ndarray:
    """Keys such that linked sets have one in common.

    Of ``parts`` ranges of hash values, linked sets differ in at most ``differing``. If fewer than the
    other ranges are empty for one of the two, a range with elements is the same in both. A set with
    too many empty ranges tries another scrambling as well.
    """
    out = []
    with np.errstate(over="ignore"):
        for level, parts, differing in levels(limit, len(elements)):
            for salt in range(SALTS + 1):
                values = elements if not salt else np.sort(mix64(elements + np.uint64(salt) * _STEP))
                mark = np.uint64(level * (SALTS + 1) + salt) * _LEVEL
                if salt == SALTS:
                    out.append(mix64(np.array([mark])))
                    break
                width = ((1 << 64) - 1) // parts
                cuts = np.searchsorted(values, np.arange(1, parts, dtype=np.uint64) * np.uint64(width))
                cuts = np.concatenate([[0], cuts, [len(values)]])
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(values + _LEVEL))])
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                held = sums[cuts[full + 1]] - sums[cuts[full]]
                out.append(mix64(held + full.astype(np.uint64) * _STEP + mark))
                if len(full) > differing:
                    break
    return np.concatenate(out)


def _fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix64(elements ^ _STEP)) + np.uint64(len(elements))
        b = np.add.reduce(mix64(elements + _STEP * np.uint64(3)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Array of n lists; ``rows`` is the list of each value."""
    order = np.argsort(rows, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order]))


def sketched(docs: DataFrame, key: str, text: str, n: int, limit: Threshold) -> DataFrame:
    """Per row: key, n_shingles, fingerprint (f1, f2), and what its set shows to others.

    Shown elements are counted inside each batch first. One that several sets of the batch have is
    passed on once, in ``common``, and counts in ``surplus`` of each; the rest is in ``own``. ``surplus``
    starts from minus the number needed. Rows with equal sets in a batch show theirs once, so an element of
    a third of all rows is passed on once a batch.
    """
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"doc {kind}, n_shingles bigint, f1 bigint, f2 bigint, surplus bigint, own array<bigint>, common array<bigint>"
    shape = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, shown, rows, seen = [], [], [], [], set()
            surplus = np.zeros(batch.num_rows, dtype=np.int64)
            for i, body in enumerate(batch.column(1)):
                elements = shingle_set(body.as_py(), n)
                sizes.append(len(elements))
                prints.append(_fingerprint(elements) if len(elements) else (None, None))
                if len(elements) and prints[-1] not in seen:
                    seen.add(prints[-1])
                    shown.append(elements[: limit.shown(len(elements))])
                    rows.append(np.full(len(shown[-1]), i))
                    surplus[i] = -limit.needed(len(elements))
            every = np.concatenate([np.empty(0, np.uint64), *shown]).view(np.int64)
            row = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
            order = np.argsort(every, kind="stable")
            every, row = every[order], row[order]
            fresh = np.ones(len(every), dtype=bool)
            fresh[1:] = every[1:] != every[:-1]
            several = ~fresh
            several[:-1] |= ~fresh[1:]
            surplus += np.bincount(row[several], minlength=batch.num_rows)
            once = fresh & several
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
                 pa.array([p[1] for p in prints], pa.int64()), pa.array(surplus),
                 _lists(row[~several], every[~several], len(sizes)), _lists(row[once], every[once], len(sizes))], schema=shape,
            )

    return docs.select(key, text).mapInArrow(run, ddl)


SEVERAL = 0  #: stands for several sets of a batch


def _found_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, times): how many elements that a set shows are other sets' too; rows (element, node) come
    sorted by element."""
    last = None  # element, its one node so far or None if it has several, rows of that node
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(i).to_numpy() for i in range(2))
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        low, high = np.minimum.reduceat(node, starts), np.maximum.reduceat(node, starts)
        shared = (low != high) | np.logical_or.reduceat(node == SEVERAL, starts)
        before = []
        if last is not None and last[0] == key[0]:
            shared[0] |= last[1] != low[0]
            if shared[0] and last[1] is not None:
                before.append((last[1], last[2]))
        lengths = np.diff(np.append(starts, len(key)))
        if shared[-1]:
            last = (key[-1], None, 0)
        else:
            earlier = last[2] if len(starts) == 1 and last is not None and last[0] == key[0] else 0
            last = (key[-1], node[-1], earlier + int(lengths[-1]))
        nodes, times = np.unique(node[np.repeat(shared, lengths) & (node != SEVERAL)], return_counts=True)
        nodes = np.concatenate([nodes, np.array([b[0] for b in before], dtype=np.int64)])
        times = np.concatenate([times, np.array([b[1] for b in before], dtype=np.int64)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(times)], names=["node", "times"])


def _may_link(rows: DataFrame) -> DataFrame:
    """(node) of the sets that show enough elements of other sets; ``rows`` are of :func:`sketched`.

    A set that several batches hold has the same count in each, so sums keep their sign.
    """
    own = rows.select(F.explode("own").alias("key"), F.col("f1").alias("node"))
    common = rows.select(F.explode("common").alias("key"), F.lit(SEVERAL).cast("bigint").alias("node"))
    dealt = own.union(common).repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_found_elsewhere, "node bigint, times bigint")
    start = rows.where("n_shingles > 0").select(F.col("f1").alias("node"), F.col("surplus").alias("times"))
    return found.union(start).groupBy("node").agg(F.sum("times").alias("times")).where("times >= 0").select("node")


def described(texts: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """Per row of (text): fingerprint f1, part keys, and sets it shares a key with.

    Keys are combined inside each batch first: a key that several of its sets have is passed on by one
    of them, the others name that one in ``near``. A group of copies thus sends each key once a batch.
    """
    ddl = "f1 bigint, keys array<bigint>, near array<bigint>"
    shape = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, rows, seen = [], [], [], set()
            for i, body in enumerate(batch.column(0)):
                elements = shingle_set(body.as_py(), n)
                prints.append(_fingerprint(elements) if len(elements) else (None, None))
                if len(elements) and prints[-1] not in seen:
                    seen.add(prints[-1])
                    keys.append(part_keys(elements, limit))
                    rows.append(np.full(len(keys[-1]), i))
            every = np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)
            row = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
            order = np.argsort(every, kind="stable")
            every, row = every[order], row[order]
            fresh = np.ones(len(every), dtype=bool)
            fresh[1:] = every[1:] != every[:-1]
            holder = row[np.maximum.accumulate(np.where(fresh, np.arange(len(every)), 0))]
            pairs = np.unique(np.stack([row[~fresh], holder[~fresh]], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            first = np.array([p[0] or 0 for p in prints], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in prints], pa.int64()), _lists(row[fresh], every[fresh], len(prints)),
                 _lists(pairs[:, 0], first[pairs[:, 1]], len(prints))], schema=shape,
            )

    return texts.select("text").mapInArrow(run, ddl)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each set of a key to the key's first; rows come sorted by key and set."""
    last = None
    for batch in batches:
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(key):
            continue
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        goes_on = last is not None and last[0] == key[0]
        fresh[0] = not goes_on
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
        head = np.where(at >= 0, node[np.maximum(at, 0)], last[1] if goes_on else 0)
        last = (key[-1], head[-1])
        off = node != head
        pairs = np.unique(np.stack([node[off], head[off]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


# ---- regions ---------------------------------------------------------------------------------------


class Region:
    """Sets of one region, their elements renumbered and laid end to end."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.flat.max()) + 1, dtype=bool)

    def common(self, pivot: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of intersection and union of a set with others."""
        own = self.flat[self.start[pivot] : self.start[pivot + 1]]
        self.mark[own] = True
        if len(others) == len(self.size):
            inter = np.add.reduceat(self.mark[self.flat], self.start[:-1], dtype=np.int64)
        else:
            sizes = self.size[others]
            at = np.repeat(self.start[others] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            inter = np.add.reduceat(self.mark[self.flat[at]], np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
        self.mark[own] = False
        return inter, self.size[pivot] + self.size[others] - inter


def rare_groups(sets: list[np.ndarray], limit: Threshold) -> np.ndarray:
    """Number of the group of each set; linked sets are in one group.

    With elements in order of their frequency among these sets, the rarest first, linked sets
    share one of their first ``size - least intersection + 1``. Passages that many sets hold come last.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(sets)), size)
    ordered = np.sort(owner * len(counts) + rank[flat]) % len(counts)
    place = np.arange(len(ordered)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    early = place < np.repeat(limit.prefix(size), size)
    shared = early & (np.sort(counts)[ordered] > 1)
    token, node = ordered[shared], owner[shared]
    by_token = np.argsort(token, kind="stable")
    token, node = token[by_token], node[by_token]
    same = np.flatnonzero(token[1:] == token[:-1])
    return merge(np.arange(len(sets)), node[same], node[same + 1])


def linked_classes(sets: list[np.ndarray], limit: Threshold) -> np.ndarray:
    """Number of the class of each set; classes are closed under links."""
    groups = rare_groups(sets, limit)
    out = np.arange(len(sets))
    order = np.argsort(groups, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
        if len(part) > 1:
            out[part] = part[_by_pivots([sets[i] for i in part], limit)]
    return out


def _by_pivots(sets: list[np.ndarray], limit: Threshold) -> np.ndarray:
    """Classes of sets that are likely close to one another.

    A pivot is compared with all sets left. Those it links with are one class; whatever else links
    with one of them lies within two radii of the pivot, so only sets between one and two radii are
    compared further, with sets of other classes that the triangle inequality leaves. Then the
    pivot's class needs no more comparison and goes.
    """
    region, parent = Region(sets), np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)

    left = np.arange(len(sets))
    while len(left) > 1:
        pivot = int(left[0])
        inter, union = region.common(pivot, left)
        ball, near = limit.linked(inter, union), limit.within(inter, union, 2)
        join(pivot, left[ball])
        distance = (union - inter) / union
        radius = 1 - limit.num / limit.den + 1e-9
        done = ball.copy()
        for k in np.flatnonzero(near & ~ball):
            own = root(int(left[k]))
            open_ = ~done | ball
            reach = open_ & (np.abs(distance - distance[k]) <= radius)
            others = np.array([j for j in left[reach] if root(int(j)) != own], dtype=np.int64)
            if len(others):
                i, u = region.common(int(left[k]), others)
                join(int(left[k]), others[limit.linked(i, u)])
            done[k] = True
        left = left[~done]
    return np.array([root(i) for i in range(len(sets))])


def _join_regions(members: DataFrame, limit: Threshold) -> DataFrame:
    """(node, root) of each region: every set points to the first of its class."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        classes = linked_classes([np.asarray(s, dtype=np.int64) for s in frame["elements"]], limit)
        return pd.DataFrame({"u": frame["node"], "v": frame["node"].to_numpy()[classes]})

    return members.groupBy("region").applyInPandas(run, "u string, v string").where("u <> v")


def _split_regions(large: DataFrame, limit: Threshold, salt: int) -> tuple[DataFrame, DataFrame]:
    """Members of the Voronoi regions of regions too large for a task, and members of the regions that pivots
    do not split.

    Pivots are the first sets by a hash of their name. Members meet the pivots in as many groups as
    their weight needs; a member belongs to every region whose pivot is no farther than its nearest plus
    two radii, so linked sets always meet in one. Sets that are all close to one another, or all far from every
    pivot, belong to nearly all; such a region is left as it is, and its members are not copied.
    """
    weights = large.groupBy("region").agg(F.ceil(4 * F.sum("n") / REGION).cast("int").alias("groups"))
    weights = cut_lineage(weights)
    slot = F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(PIVOTS)).alias("slot")
    order = F.struct(F.xxhash64(F.lit(salt), F.lit(1), "node"), "node")
    # the first member of each slot: combined inside tasks, so a hot region sends few rows
    pivots = large.groupBy("region", slot).agg(F.min_by("elements", order).alias("elements")).join(weights, "region")
    pivots = pivots.select(F.concat("region", F.lit("")).alias("of"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "slot", "elements")
    dealt = large.join(weights, "region").withColumn("grp", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))

    def assign(frame: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=["region", "node", "n", "slots"], dtype=object)
        centres = centres.sort_values("slot", ignore_index=True)
        sets = [np.asarray(s, dtype=np.int64) for s in (*centres["elements"], *frame["elements"])]
        region, k = Region(sets), len(centres)
        others = np.arange(k, len(sets))
        far = np.empty((k, len(others)))
        for i in range(k):
            inter, union = region.common(i, others)
            far[i] = (union - inter) / union
        window = far <= far.min(axis=0) + 2 * (1 - limit.num / limit.den) + 1e-9
        slots = centres["slot"].to_numpy()
        return pd.DataFrame({"region": frame["region"], "node": frame["node"], "n": frame["n"], "slots": [slots[w].tolist() for w in window.T]})

    placed = cut_lineage(dealt.groupBy("region", "grp").cogroup(pivots.groupBy("of", "grp")).applyInPandas(
        assign, "region string, node string, n bigint, slots array<bigint>"
    ))
    made = placed.select("region", "n", F.explode("slots").alias("slot")).groupBy("region", "slot").agg(F.sum("n").alias("w"))
    made = made.groupBy("region").agg(F.sum("w").alias("every"), F.max("w").alias("most"))
    held = placed.groupBy("region").agg(F.sum("n").alias("w")).join(made, "region")
    apart = cut_lineage(held.where((F.col("every") <= SPREAD * F.col("w")) & (2 * F.col("most") <= F.col("w"))).select("region"))
    split = large.join(apart, "region", "left_semi").join(placed.select("region", "node", F.explode("slots").alias("slot")), ["region", "node"])
    split = split.select(F.concat_ws("/", "region", "slot").alias("region"), "node", "n", "elements")
    return cut_lineage(split), large.join(apart, "region", "left_anti")


def _first_shared(batches: Iterator[pa.RecordBatch], limit: Threshold) -> Iterator[pa.RecordBatch]:
    """Of each set, the shared tokens among its first ones; rows (set, size, token, sets that hold it) come
    sorted by set, frequency and token. Tokens that no other set holds are not here but come first."""
    held = None
    for batch in batches:
        node, n, token = (batch.column(i).to_numpy() for i in range(3))
        shared = batch.column(4).to_numpy()
        if not len(node):
            continue
        fresh = np.ones(len(node), dtype=bool)
        fresh[1:] = node[1:] != node[:-1]
        goes_on = held is not None and held[0] == node[0]
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(node)), 0))
        place = np.arange(len(node)) - start
        if goes_on:
            place[: int(np.argmax(fresh[1:])) + 1 if fresh[1:].any() else len(node)] += held[1]
        held = (node[-1], place[-1] + 1)
        keep = place + (n - shared) < limit.prefix(n)
        yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep])], names=["key", "node"])


def _split_by_rare(large: DataFrame, limit: Threshold) -> DataFrame:
    """:func:`rare_groups` over regions too large for a task, as Spark jobs."""
    named = large.withColumn("id", F.xxhash64("node"))
    tokens = named.select(F.col("id"), "n", "region", F.explode("elements").alias("e")).select(
        F.xxhash64("region", "e").alias("token"), "id", "n"
    )
    held = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    held = held.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("id")))
    # the window has dealt the rows by set already
    ordered = held.select("id", "n", "token", "df", "shared").sortWithinPartitions("id", "df", "token")
    first = ordered.mapInArrow(lambda b: _first_shared(b, limit), "key bigint, node bigint")
    edges = first.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "u bigint, v bigint").distinct()
    groups = components(edges).select(F.col("node").alias("id"), F.hex("component").alias("group"))
    moved = named.join(groups, "id")  # a set without a group links with nothing
    return cut_lineage(moved.select(F.concat_ws("/", "region", "group").alias("region"), "node", "n", "elements"))


def _in_blocks(large: DataFrame) -> DataFrame:
    """Regions that pivots do not split (all sets close to one another) as pairs of two of their three or more blocks."""
    weights = large.groupBy("region").agg(F.ceil(2 * F.sum("n") / REGION).cast("int").alias("blocks"))
    placed = large.join(weights, "region").withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("b <> other")
    pair = F.concat_ws("+", "region", F.least("b", "other"), F.greatest("b", "other"))
    return paired.select(pair.alias("region"), "node", "n", "elements")


def _blocks_joined(large: DataFrame, limit: Threshold) -> list[DataFrame]:
    """:func:`_join_regions` of the pairs of blocks, a share of the pairs at a time: a set is in as many pairs as its
    region has blocks, and all at once would need disk that grows with the square of a region."""
    own = large.groupBy("region").agg(F.sum("n").alias("w")).agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.ceil(2 * F.col("w") / REGION)).alias("paired")
    ).first()
    slices = -(-int(own["paired"] or 0) // max(SLICE, 2 * int(own["w"] or 0)))
    out = []
    for number in range(slices):
        some = _in_blocks(large).where(F.pmod(F.xxhash64(F.lit("slice"), "region"), F.lit(slices)) == number)
        out.append(cut_lineage(_join_regions(some, limit)))
        del some
        release(large.sparkSession)
    return out


def _verified(members: DataFrame, limit: Threshold) -> DataFrame:
    """(node, component) of all nodes that link with another.

    Regions too large for a task are split by rare shingles as long as that takes a tenth off their weight: among
    fewer sets fewer shingles are shared, and a set that shares too few with its own group goes. Pivots split what is
    left, where they can; the rest is joined block by block.
    """
    fits, close, rounds, pivots, before = [], [], 0, 0, math.inf
    todo = members
    while True:
        sized = todo.groupBy("region").agg(F.sum("n").alias("w")).where(F.col("w") > REGION)
        heavy = {r.region: r.w for r in sized.limit(100_000).collect()}
        if not heavy:
            fits.append(todo)
            break
        names = todo.sparkSession.createDataFrame([(k,) for k in heavy], "region string")
        fits.append(todo.join(F.broadcast(names), "region", "left_anti"))
        large = todo.join(F.broadcast(names), "region", "left_semi")
        rounds += 1
        weight = sum(heavy.values())
        if not pivots and 10 * weight <= 9 * before:
            before, todo = weight, _split_by_rare(large, limit)
            release(large.sparkSession)
            continue
        pivots += 1
        if pivots > 3:
            close.append(large)
            break
        todo, whole = _split_regions(large, limit, rounds)
        close.append(whole)
        release(large.sparkSession)
    every = functools.reduce(DataFrame.unionByName, fits)
    parts = [cut_lineage(_join_regions(every, limit))]
    for whole in close:
        parts += _blocks_joined(whole, limit)
    edges = functools.reduce(DataFrame.unionByName, parts)
    if rounds < 2:  # each class lies in one region and points to its first set
        firsts = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(firsts)
    return components(edges)


# ---- the join --------------------------------------------------------------------------------------


def _left(docs: DataFrame, key: str, text: str, n: int, limit: Threshold) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, str]:
    """(doc, n_shingles, f1, f2) of each row; (f1, f2, first) of each set; the sets that may link; and a written
    table of texts, at least one of each set that may link."""
    spark = docs.sparkSession
    rows, path = written(sketched(docs, key, text, n, limit), "ngramrows")
    meta = cut_lineage(rows.select("doc", "n_shingles", "f1", "f2"))
    classes = meta.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc").alias("first"))
    alive = cut_lineage(classes.join(_may_link(rows).withColumnRenamed("node", "f1"), "f1", "left_semi"))
    drop_written(spark, path)
    # a set is read from its first document; rows without a key are few or equal to others, and are all read
    bloom = build_filter(alive.select(F.col("first").cast("string").alias("entry")))
    asked = docs.where(probe_filter(spark, bloom, F.coalesce(F.col(key).cast("string"), F.lit("")))).select(key, text)
    firsts = alive.select(F.col("first").alias(key)).distinct()
    chosen = asked.join(firsts, key, "left_semi").select(F.col(text).alias("text"))
    keyless = docs.where(F.col(key).isNull()).select(F.col(text).alias("text"))
    texts, path = written(chosen.union(keyless), "ngramtexts")
    return meta, classes, alive, texts, path


def _candidates(texts: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """(node, component) of the sets that share part keys."""
    rows, path = written(described(texts, n, limit), "ngramkeys")
    flat = rows.select(F.explode("keys").alias("key"), F.col("f1").alias("node"))
    chained = flat.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "u bigint, v bigint")
    nearby = rows.select(F.col("f1").alias("u"), F.explode("near").alias("v")).where("u <> v")
    edges = cut_lineage(chained.union(nearby).distinct())
    drop_written(texts.sparkSession, path)
    return cut_lineage(components(edges))


def ngram_classes(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``.

    Two rows link when ``den`` times the intersection of their shingle sets is at least ``num`` times
    the union; component_id is the smallest key that links reach. Every link counts: no pair of sets is
    left out and none is added. Texts without words have an empty set and link with nothing; equal
    sets are one class, however many rows have them; a null key is never the smallest of a class (a class
    of null keys only has null); repeated rows and an empty table are fine. No other column is read.
    """
    spark = docs.sparkSession
    limit = Threshold(num, den)
    meta, classes, alive, texts, path = _left(docs, key, text, n, limit)
    groups = _candidates(texts, n, limit)
    release(spark)

    name = F.concat_ws(":", F.hex("f1"), F.hex("f2"))
    wanted = cut_lineage(alive.join(groups, F.col("f1") == F.col("node")).select("f1", "f2", "first", "component"))
    shape = arrow_schema("f1 bigint, f2 bigint, elements array<bigint>")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in (shingle_set(t.as_py(), n) for t in batch.column(0)) if len(s)]
            prints = [_fingerprint(s) for s in found]
            lists = _lists(np.repeat(np.arange(len(found)), [len(s) for s in found]),
                           np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64), len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), lists], schema=shape
            )

    found = texts.mapInArrow(sets, "f1 bigint, f2 bigint, elements array<bigint>")
    members = found.join(wanted, ["f1", "f2"]).groupBy("f1", "f2").agg(
        F.first("component").alias("component"), F.first("elements").alias("elements")
    ).select(F.hex("component").alias("region"), name.alias("node"), F.size("elements").cast("bigint").alias("n"), "elements")
    members = cut_lineage(members)
    drop_written(spark, path)
    joined = _verified(members, limit)
    roots = wanted.select("f1", "f2", "first", name.alias("node")).join(joined.withColumnRenamed("component", "root"), "node")
    least = roots.groupBy("root").agg(F.min("first").alias("least"))
    moved = roots.join(least, "root").select("f1", "f2", "least")
    labels = classes.join(moved, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("least", "first").alias("label"))
    return meta.join(labels, ["f1", "f2"], "left").select(
        F.col("doc").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc")).alias("component_id"),
    )
