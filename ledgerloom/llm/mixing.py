"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded choice."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKETS = 1 << 16  #: hash buckets of the seeded order; bounds the rows of one pattern's running sum
ZONE = 4096  #: least number of documents looked at where a pattern's quota ends
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1  #: the ends of the seeded order


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def target_words(sizes: dict[str | None, int], weights: Sequence[float], repeats: int) -> dict[str | None, float]:
    """Words wanted of each source: the total by weight, at most ``repeats`` times a source's size.

    What a full source cannot take is shared among the others by weight, again and again until
    no source is above its bound. Sources stand in code-point order, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in full]
        left, share = total - sum(full.values()), sum(weight[s] for s in rest)
        wanted = {s: left * weight[s] / share for s in rest}
        above = [s for s in rest if wanted[s] > repeats * sizes[s]]
        if not above:
            return full | wanted
        full |= {s: float(repeats * sizes[s]) for s in above}


def min_cost_flow(edges: list[tuple[int, int, int, int]], nodes: int, source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) edge of a largest flow of least cost.

    Successive shortest paths with node potentials; costs are not negative.
    """
    ends, room, cost, at = [], [], [], [[] for _ in range(nodes)]
    for a, b, capacity, price in edges:
        for end, r, c, start in ((b, capacity, price, a), (a, 0, -price, b)):
            at[start].append(len(ends))
            ends.append(end)
            room.append(r)
            cost.append(c)
    height = [0] * nodes
    while True:
        far, via, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in at[a]:
                step = d + cost[e] + height[a] - height[ends[e]]
                if room[e] and step < far.get(ends[e], step + 1):
                    far[ends[e]], via[ends[e]] = step, e
                    heapq.heappush(queue, (step, ends[e]))
        if sink not in far:
            return [room[2 * i + 1] for i in range(len(edges))]
        height = [h + far.get(n, far[sink]) for n, h in enumerate(height)]
        path, n = [], sink
        while n != source:
            path.append(via[n])
            n = ends[via[n] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def route(
    members: dict[str, tuple], sizes: dict[str, int], quotas: dict[str | None, int], repeats: int
) -> dict[str, int]:
    """Words to take of each membership pattern.

    A pattern offers its size once for every repetition, the later the dearer; it feeds the sources
    it belongs to, and each source takes up to its quota.
    """
    names, sources = list(members), list(quotas)
    place = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    sink = 1 + len(names) + len(sources)
    edges, offers = [], []
    for i, p in enumerate(names):
        for r in range(repeats):
            offers.append((p, len(edges)))
            edges.append((0, 1 + i, sizes[p], r * r))
        edges += [(1 + i, place[s], repeats * sizes[p], 0) for s in members[p]]
    edges += [(place[s], sink, quotas[s], 0) for s in sources]
    flow = min_cost_flow(edges, sink + 1, 0, sink)
    taken = dict.fromkeys(names, 0)
    for p, e in offers:
        taken[p] += flow[e]
    return taken


def _filled(zone: pd.DataFrame) -> pd.DataFrame:
    """Go through one pattern's zone in the seeded order and take every document that fits the room left.

    A span (lo, hi, cap) holds the documents from lo to hi of at most ``cap`` words. A document above the cap is passed
    over by it; one that the cap would let in but the room does not ends the span.
    """
    zone = zone.sort_values("hash")
    room, cap, lo = (int(zone[c].iloc[0]) for c in ("room", "cap", "lo"))
    spans = []
    for h, size, least in zip(zone["hash"].tolist(), zone["size"].tolist(), zone["least"].tolist(), strict=True):
        if size <= room:
            room -= size
        elif least <= cap:
            spans.append((lo, h - 1, cap))
            lo, cap = h + 1, room
    columns = [[s[i] for s in spans] for i in range(3)]
    return pd.DataFrame([(zone["pattern"].iloc[0], room, lo, cap, *columns)], columns=["pattern", "room", "lo", "cap", "los", "his", "caps"])


def _spans(sized: DataFrame, rests: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """Spans of the seeded order that hold ``rests`` words of each pattern, or what comes nearest: each
    document in turn is taken if it fits the room left, until no later one fits.

    Whole buckets are summed; only in the zone where a room ends are documents looked at singly. If the zone
    leaves room, the next turn goes on behind it.
    """
    spark = sized.sparkSession
    spans: dict[str, list[tuple[int, int, int]]] = {p: [] for p in rests}
    todo = [(p, rest, LOWEST >> 48) for p, rest in rests.items() if rest > 0]
    bucket = F.shiftright(F.col("hash"), 48).alias("bucket")
    running = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    while todo:
        start = {p: (room, first) for p, room, first in todo}
        asked = F.broadcast(spark.createDataFrame(todo, "pattern string, cap bigint, start bigint"))
        fitting = sized.join(asked, "pattern").where((bucket >= F.col("start")) & (F.col("size") <= F.col("cap")))
        sums = fitting.groupBy("pattern", "cap", bucket).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        along = sums.withColumn("upto", F.sum("size").over(running))
        along = along.withColumn("seen", F.sum(F.when(F.col("upto") > F.col("cap"), F.col("n")).otherwise(0)).over(running))
        ends = along.groupBy("pattern").agg(
            F.sum("size").alias("size"),
            F.max(F.when(F.col("upto") <= F.col("cap"), F.struct("bucket", "upto"))).alias("full"),
            F.min(F.when(F.col("seen") >= ZONE, F.col("bucket"))).alias("to"),
        ).where("size > 0").select("pattern", "full.bucket", "full.upto", "to").collect()
        zones = []
        for r in ends:
            cap, first = start[r.pattern]
            after = first if r.bucket is None else r.bucket + 1
            zones.append((r.pattern, cap - (r.upto or 0), cap, first << 48, after, r.to))
        todo = []
        if not zones:
            break
        ddl = "pattern string, room bigint, cap bigint, lo bigint, after bigint, to bigint"
        inside = (bucket >= F.col("after")) & (F.col("to").isNull() | (bucket <= F.col("to"))) & (F.col("size") <= F.col("cap"))
        zone = sized.join(F.broadcast(spark.createDataFrame(zones, ddl).where("room > 0")), "pattern").where(inside).groupBy("pattern", "hash").agg(
            F.sum("size").cast("bigint").alias("size"), F.min("size").cast("bigint").alias("least"),
            *[F.first(c).alias(c) for c in ("room", "cap", "lo")],
        )
        kind = "pattern string, room bigint, lo bigint, cap bigint, los array<bigint>, his array<bigint>, caps array<bigint>"
        looked = {r.pattern: r for r in zone.groupBy("pattern").applyInPandas(_filled, kind).collect()}
        for p, room, cap, lo, after, to in zones:
            if p in looked:
                r = looked[p]
                spans[p] += list(zip(r.los, r.his, r.caps, strict=True))
                end = HIGHEST if to is None else ((to + 1) << 48) - 1
                if r.lo <= end:
                    spans[p].append((r.lo, end, r.cap))
                if to is not None and r.room and (to + 1) << 48 <= HIGHEST:
                    todo.append((p, r.room, to + 1))
            else:  # the room ends with a bucket, or all that fits is taken
                spans[p].append((lo, (after << 48) - 1, cap))
    return spans


def plan_mix(
    sized: DataFrame, weights: Sequence[float], repeats: int = 3, max_patterns: int = 20_000
) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """(plan, source sizes, targets) for rows (pattern, sources, hash, size).

    ``plan`` has one row per membership pattern: how often each of its documents is taken (``base``),
    and for the last, partial time the spans of the seeded order (:func:`_spans`). Only sums per pattern, and
    the spans, reach the driver; more than
    ``max_patterns`` patterns raise an error, so the plan is small enough to broadcast.
    """
    spark = sized.sparkSession
    heads = sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"))
    rows = heads.limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    members = {r.pattern: tuple(dict.fromkeys(r.sources)) for r in rows}
    sizes: dict[str | None, int] = {}
    for r in rows:
        for s in members[r.pattern]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    targets = target_words(sizes, weights, repeats) if rows else {}
    quotas = {s: round(t) for s, t in targets.items()}
    size_of = {r.pattern: r["size"] for r in rows}
    takes = route(members, size_of, quotas, repeats)
    base = {p: takes[p] // n if n else 0 for p, n in size_of.items()}
    spans = _spans(sized, {p: takes[p] % n if n else 0 for p, n in size_of.items()})
    plan = [(p, base[p], spans[p]) for p in size_of]
    return spark.createDataFrame(plan, "pattern string, base bigint, spans array<struct<lo: bigint, hi: bigint, cap: bigint>>"), sizes, targets


def _drawn(docs: DataFrame, key: str, text: str, sources: Column, seed: int) -> DataFrame:
    """``docs`` plus the membership pattern and the place in the seeded order."""
    listed = F.array_sort(F.array_distinct(sources))
    order = F.xxhash64(F.lit(seed), key, F.crc32(F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumns({"_sources": listed, "_pattern": F.to_json(listed), "_hash": order})


def _copies(plan: DataFrame, rows: DataFrame, size: Column) -> DataFrame:
    plan = plan.select(F.col("pattern").alias("_pattern"), F.col("base").alias("_base"), F.col("spans").alias("_spans"))
    joined = rows.withColumn("_words", size).join(F.broadcast(plan), "_pattern")
    partial = F.exists("_spans", lambda s: F.col("_hash").between(s["lo"], s["hi"]) & (F.col("_words") <= s["cap"]))
    return joined.withColumn("_copies", F.col("_base") + F.when(partial, 1).otherwise(0))


def mix_table(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    repeats: int = 3,
    sources: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """((key, sources, size, copies), source sizes, targets): how often the mix takes each document.

    ``sources`` is an array of the sources that a document belongs to (its column ``source`` alone by
    default); they may overlap. Documents are summed by membership pattern, a min-cost flow routes the
    patterns' words to the sources' targets with convex costs of repetition, and each pattern takes
    its documents by a seeded order: a number of whole rounds, then each document that fits the room left,
    until no later one fits.

    A null text has size 0; a null source is a source, the last; rows equal in id and text are taken
    together; a null id is an id. Reruns agree, whatever the partitions. An empty table gives an empty
    result. No other column is read.
    """
    sources = F.array("source") if sources is None else sources
    rows = _drawn(docs, key, text, sources, seed).select(key, "_sources", "_pattern", "_hash", words(text).alias("_size"))
    rows, _ = written(rows, "mixsizes")
    sized = rows.select(F.col("_pattern").alias("pattern"), F.col("_sources").alias("sources"),
                        F.col("_hash").alias("hash"), F.col("_size").alias("size"))
    plan, sizes, targets = plan_mix(sized, weights, repeats)
    taken = _copies(plan, rows, F.col("_size")).select(
        key, F.col("_sources").alias("sources"), F.col("_size").alias("size"), F.col("_copies").alias("copies")
    )
    return taken, sizes, targets


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    repeats: int = 3,
    sources: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix_table` takes it.

    The texts stay where they are: the plan has a row per membership pattern and is broadcast.
    """
    sources = F.array("source") if sources is None else sources
    rows = _drawn(docs, key, text, sources, seed)
    sized = rows.select(F.col("_pattern").alias("pattern"), F.col("_sources").alias("sources"),
                        F.col("_hash").alias("hash"), words(text).alias("size"))
    plan, _, _ = plan_mix(written(sized, "mixsizes")[0], weights, repeats)
    taken = _copies(plan, rows, words(text)).where("_copies > 0")
    again = F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))
    return taken.select(*docs.columns, again.alias("_again")).drop("_again")
