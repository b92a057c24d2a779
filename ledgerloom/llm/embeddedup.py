"""Embedding near-dedup: a sliced join of rotated unit vectors under a subspace bound."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import arrow_schema, cut_lineage, merge, written
from .vectors import classes, matrix, usable

HEAD = 32  #: coordinates of the subspace that names candidates, or a quarter of the width if that is more
TASK = 16_000  #: vectors of a slice; a task joins two slices
CHUNK, ROW = 512, 8192  #: vectors compared at a time
PAIRS = 50_000  #: candidate pairs verified at a time


@functools.cache
def rotation(width: int) -> np.ndarray:
    """One fixed orthogonal matrix per width, so that no subspace is special."""
    q, r = np.linalg.qr(np.random.default_rng(17).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)


def _head(width: int) -> int:
    """Coordinates of the rotated vectors that name candidates."""
    return min(width, max(HEAD, width // 4))


def _joined(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one task, the pairs of slices i and j: per vector the number of links and the first vector of its
    local class.

    A distance in the subspace is never above the whole one, so it names candidates and loses none; the cosine
    decides, in double precision.
    """
    frame = frame.sort_values("node", ignore_index=True)
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    node, copies, part = frame["node"].to_numpy(), frame["copies"].to_numpy(), frame["s"].to_numpy()
    plain = unit(np.stack(frame["v"].to_list()))
    width = plain.shape[1]
    sub = (plain @ rotation(width)[:, : _head(width)]).astype(np.float32)
    half = (sub * sub).sum(axis=1, keepdims=True) / 2
    left = np.hstack([sub, np.ones_like(half), -half])
    right = np.hstack([sub, -half, np.ones_like(half)])
    floor = np.float32(cosine - 1 - 1e-5 - 1e-7 * sub.shape[1])  # minus half the squared distance of unit vectors that link
    links, label = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))
    xs, ys = np.flatnonzero(part == i), np.flatnonzero(part == j)
    for at in range(0, len(xs), CHUNK):
        x = xs[at : at + CHUNK]
        y = ys[at:] if i == j else ys
        for start in range(0, len(y), ROW):
            z = y[start : start + ROW]
            hit = np.flatnonzero(left[x] @ right[z].T >= floor)
            for k in range(0, len(hit), PAIRS):
                a, b = x[hit[k : k + PAIRS] // len(z)], z[hit[k : k + PAIRS] % len(z)]
                if i == j:
                    later = node[a] < node[b]
                    a, b = a[later], b[later]
                close = np.einsum("ij,ij->i", plain[a], plain[b]) >= cosine
                a, b = a[close], b[close]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                label = merge(label, a, b)
    some = np.flatnonzero(links)
    return pd.DataFrame({"node": node[some], "links": links[some], "root": node[label[some]]})


def vector_links(table: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) per row of ``table``.

    Rows link when the cosine of their vectors is at least ``cosine``. Unit vectors that link are within
    a squared distance of 2 - 2 cosine, so in any subspace too: all pairs of slices meet once, are compared in one
    subspace and what is left is verified. Exact: no link is lost, none added. A task holds at most two slices.
    The pairs grow with the square of the vectors; a vector is sent once for each slice of ``TASK``.

    Null, empty and zero vectors and vectors with null or non-finite components link with nothing; a row
    without an id takes no part (no links, component null, not kept); vectors of different widths
    never link; equal vectors are joined as one and count as links of each other; rows that share an id are
    one vertex; an empty table stays empty. No other column is read.
    """
    rows = usable(table, key, vector)
    singles, _ = written(classes(rows), "vectors")
    width = F.size("v").alias("width")
    sizes = singles.groupBy(width).agg(F.ceil(F.count(F.lit(1)) / TASK).cast("int").alias("slices"))
    dealt = singles.withColumn("width", width).join(F.broadcast(sizes), "width").withColumn("s", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    paired = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    tasks = paired.withColumns({"i": F.least("s", "o"), "j": F.greatest("s", "o")}).drop("o", "slices")
    found = tasks.groupBy("width", "i", "j").applyInPandas(
        lambda frame: _joined(frame, cosine), "node bigint, links bigint, root bigint"
    )
    found = cut_lineage(found)
    edges = found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct()
    groups = components(edges)
    per_class = (
        singles.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(groups, "node", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "node").alias("component_id"))
    )
    # equal vectors meet their class by the vector; ids alone may repeat
    linked = rows.join(per_class, "v").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return table.select(key).join(linked, F.col(key) == F.col("id"), "left").select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", key).cast("bigint").alias("component_id"),
        F.coalesce(F.coalesce("component_id", key) == F.col(key), F.lit(False)).alias("kept"),
    )
