"""Joins, lags and ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Number of heaviest keys handled by broadcast. Every other key then owns less than
#: 1/HOT_KEYS of the rows, so the plain shuffle join is balanced.
HOT_KEYS = 512


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str]):
    """First row of each key as an aggregate: it combines map-side, unlike ``row_number``."""
    picked = F.min_by(F.struct(*cols), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str]):
    picked = F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(picked).select(*keys, "_last.*")


def lookup_weighted(
    big: DataFrame, dim: DataFrame, on: Sequence[str], weight: str, how: str = "inner"
) -> DataFrame:
    """Join ``big`` to ``dim`` (one row per key), where ``dim`` knows about how many rows of ``big``
    each key owns. ``how`` is inner or left.

    The heaviest keys are answered by a broadcast of at most ``HOT_KEYS`` rows. Their rows, and rows
    without a key, then pass the shuffle join under throw-away keys, spread evenly, so no task
    holds a hot key; every other key owns less than 1/HOT_KEYS of the rows.
    """
    values = [c for c in dim.columns if c not in on and c != weight]
    hot = dim.orderBy(F.desc(weight), *on).limit(HOT_KEYS)
    hot = hot.select(*on, F.struct(F.lit(True).alias("_hit"), *values).alias("_hot"))
    marked = big.join(F.broadcast(hot), list(on), "left")
    key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in on])
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    open_key = F.when(F.col("_hot").isNull() & keyed, key).otherwise(_filler(big, on))
    rest = dim.select(key.alias("_key"), F.struct(F.lit(True).alias("_hit"), *values).alias("_dim"))
    joined = marked.withColumn("_key", open_key).join(rest, "_key", "left")
    found = F.coalesce("_hot", "_dim")
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*big.columns, *[found[c].alias(c) for c in values])


def lookup_salted(
    big: DataFrame, dim: DataFrame, on: Sequence[str], salt_from: Sequence, salts: int = 64
) -> DataFrame:
    """Left join to a small-per-key dimension (one row per key) with the key spread over salts.

    For dimensions much smaller than ``big`` (one row per case, per channel): the copies of the
    dimension are cheap and the rows of a hot key land in ``salts`` partitions, which adaptive
    execution splits further where they are still oversized.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.withColumn("_salt", F.col("_salt").cast("bigint"))
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")


def _pieces(df: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    """The heaviest keys, at most ``HOT_KEYS``, with the number of pieces that each is cut into: one per
    1/HOT_KEYS of the rows of all of them, and no more than it has rows."""
    heavy = df.dropna(subset=list(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    heavy = heavy.orderBy(F.desc("_n"), *on).limit(HOT_KEYS)
    share = F.ceil(F.col("_n") * HOT_KEYS / F.sum("_n").over(Window.partitionBy()))
    return heavy.select(*on, F.least("_n", share).cast("int").alias(out))


def join_heavy(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join, inner or left, many to many, of two tables whose keys may each own any share of the rows.

    The heaviest keys of either side are counted (an aggregate that combines map-side; at most 2 * HOT_KEYS rows are
    broadcast). The rows of such a key are cut into pieces by a hash of the row, and the other side's rows of the key are
    copied once per piece, so both sides meet on a grid of (key, piece, piece) and each pair of rows meets
    once. All other keys own less than 1/HOT_KEYS of the rows. A left join cuts ``left`` only, and spreads its rows
    without a key. Rows equal in all columns are in one piece.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    on = list(on)
    cuts = _pieces(left, on, "_a")
    if how == "inner":
        cuts = cuts.join(_pieces(right, on, "_b"), on, "full")
    else:
        cuts = cuts.withColumn("_b", F.lit(1))
    cuts = F.broadcast(cuts)
    n_left, n_right = F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1))
    if how == "left":
        keyed = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on])
        n_left = F.when(keyed, n_left).otherwise(HOT_KEYS)
    own = lambda df, n: F.pmod(_row_hash(df, on), n.cast("bigint")).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    grid_left = left.join(cuts, on, "left").select(*left.columns, own(left, n_left).alias("_i"), copies(n_right).alias("_j"))
    right = right.dropna(subset=on)
    grid_right = right.join(cuts, on, "left").select(*right.columns, copies(n_left).alias("_i"), own(right, n_right).alias("_j"))
    return grid_left.join(grid_right, [*on, "_i", "_j"], how).drop("_i", "_j")


def _row_hash(df: DataFrame, but: Sequence[str] = ()) -> Column:
    """A hash of a row's plain columns, the same again when a task is retried."""
    atomic = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.NumericType)) and f.name not in but
    ]
    return F.xxhash64(*(atomic or df.columns))


def _filler(df: DataFrame, but: Sequence[str] = ()) -> Column:
    """A key that matches nothing, spread evenly and the same again when a task is retried."""
    return F.concat(F.lit("\x00"), _row_hash(df, but).cast("string"))


def left_lookup(big: DataFrame, dim: DataFrame, on: str, scope: Sequence[str]) -> DataFrame:
    """Left join on one nullable key. Rows without a key match nothing; they get a throw-away key
    so that a shuffle does not send all of them to one task."""
    keyed = big.withColumn("_key", F.coalesce(F.col(on).cast("string"), _filler(big, [on])))
    side = dim.withColumn("_key", F.col(on).cast("string")).drop(on)
    return keyed.join(side, [*scope, "_key"], "left").drop("_key")


def anti_known(df: DataFrame, known: DataFrame, on: dict[str, str], scope: Sequence[str] = ()):
    """Rows whose key is not in ``known``; ``on`` maps columns of ``df`` to columns of ``known``.
    Rows without a key are kept and spread like in :func:`left_lookup`."""
    names = {c: f"_key_{c}" for c in on}
    keys = known.select(*scope, *[F.col(on[c]).cast("string").alias(k) for c, k in names.items()])
    filler = _filler(df, list(on))
    keyed = df.withColumns({k: F.coalesce(F.col(c).cast("string"), filler) for c, k in names.items()})
    keys = keys.dropna(subset=list(names.values())).distinct()
    return keyed.join(keys, [*scope, *names.values()], "left_anti").drop(*names.values())


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-sorted by keys and order, and written once as a reliable checkpoint. A key of any share of the rows is
    spread over as many partitions as it needs."""
    return cut_lineage(df.orderBy(*keys, *order))


def _null_safe_equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    both = pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
    return pc.fill_null(both, False).to_numpy(zero_copy_only=False)


def _last_known(column: pa.Array) -> int:
    """Place of the last value that is not null, or -1."""
    if not column.null_count:
        return len(column) - 1
    valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return int(valid[-1]) if len(valid) else -1


class _Run:
    """The key that a stream of sorted rows is in: its values, its rows so far, the last value of each column."""

    def __init__(self, keys: Sequence[str], sources: Sequence[str], skip_nulls: bool):
        self.keys, self.sources, self.skip_nulls = keys, sources, skip_nulls
        self.key: list[pa.Array] | None = None
        self.last: dict[str, pa.Array] = {}
        self.n, self.one_key = 0, True  # rows of the key; has the stream had one key only?

    def starts(self, batch: pa.RecordBatch) -> np.ndarray:
        """For each row the first row of its key in the batch, -1 where the key goes on from before."""
        same = np.ones(batch.num_rows, dtype=bool)
        for i, k in enumerate(self.keys):
            c = batch.column(k)
            before = self.key[i].cast(c.type) if self.key is not None else pa.nulls(1, c.type)
            same &= _null_safe_equal(pa.concat_arrays([before, c.slice(0, len(c) - 1)]), c)
        same[0] &= self.key is not None
        return np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))

    def take(self, batch: pa.RecordBatch, starts: np.ndarray) -> None:
        first, n = int(starts[-1]), batch.num_rows
        self.one_key &= first == 0 if self.key is None else first < 0
        self.n = self.n + n if first < 0 else n - first
        self.key = [batch.column(k).slice(n - 1, 1) for k in self.keys]
        for s in self.sources:
            own = batch.column(s).slice(max(first, 0))
            at = _last_known(own) if self.skip_nulls else len(own) - 1
            if at >= 0:
                self.last[s] = own.slice(at, 1)
            elif first >= 0 or s not in self.last:
                self.last[s] = pa.nulls(1, own.type)


def _carried(ends: pa.Table, run: _Run) -> dict[int, _Run]:
    """For each partition the run that the partitions before it end in. One row per partition."""
    out, so_far = {}, None
    for row in ends.sort_by("_part").to_batches(max_chunksize=1):
        out[row.column("_part")[0].as_py()] = so_far
        here = _Run(run.keys, run.sources, run.skip_nulls)
        here.key = [row.column(k) for k in run.keys]
        here.last = {s: row.column(f"_last_{s}") for s in run.sources}
        here.n = row.column("_n")[0].as_py()
        if row.column("_one")[0].as_py() and so_far is not None and all(_null_safe_equal(a, b)[0] for a, b in zip(here.key, so_far.key, strict=True)):
            here.n += so_far.n
            for s in run.sources:  # nulls are passed over
                if run.skip_nulls and here.last[s].null_count:
                    here.last[s] = so_far.last[s]
        so_far = here
    return out


def scan_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], previous: dict[str, str] | None = None,
    skip_nulls: bool = False, position: str | None = None, sorted_before: bool = False,
) -> DataFrame:
    """``df`` with values of the previous row of its key, and the position in its key from 1, in one streaming pass.

    ``previous`` maps output column -> source column; with ``skip_nulls`` the value is the last one before the row that is
    not null. The rows are sorted by range once (:func:`in_order`). A first pass over that table gives one row per
    partition: the key and the values it ends with. These are chained on the driver, and the second pass begins
    each partition with what the ones before it end in. So no task holds a key, and the input is read once.
    ``sorted_before`` says that ``df`` is a result of this function, or of row-wise steps on one, with the same keys and
    order: it is not sorted again. The result's partitions are sorted.
    """
    previous = previous or {}
    rows = df if sorted_before else in_order(df, keys, order)
    sources = sorted(set(previous.values()))
    types = {f.name: f.dataType for f in rows.schema.fields}
    narrow = rows.select(F.spark_partition_id().alias("_part"), *[F.col(c) for c in dict.fromkeys([*keys, *sources])])
    end_fields = [T.StructField("_part", T.IntegerType()), *[T.StructField(k, types[k]) for k in keys]]
    end_fields += [T.StructField(f"_last_{s}", types[s]) for s in sources]
    end_schema = T.StructType([*end_fields, T.StructField("_n", T.LongType()), T.StructField("_one", T.BooleanType())])
    names = end_schema.fieldNames()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, part = _Run(keys, sources, skip_nulls), None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("_part").slice(0, 1)
                run.take(batch, run.starts(batch))
        if part is not None:
            columns = [part, *run.key, *[run.last[s] for s in sources], pa.array([run.n], pa.int64()), pa.array([run.one_key])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    carried = _carried(narrow.mapInArrow(ends, end_schema).toArrow(), _Run(keys, sources, skip_nulls))
    added = [T.StructField(out, types[src]) for out, src in previous.items()]
    added += [T.StructField(position, T.LongType())] if position else []
    schema = T.StructType([*rows.schema.fields, *added])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = carried.get(TaskContext.get().partitionId()) or _Run(keys, sources, skip_nulls)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, at = run.starts(batch), np.arange(batch.num_rows)
            columns = list(batch.columns)
            for src in previous.values():
                c = batch.column(src)
                known = at if not (skip_nulls and c.null_count) else np.maximum.accumulate(np.where(c.is_valid().to_numpy(zero_copy_only=False), at, -1))
                before = np.append(-1, known[:-1])
                # 0: nothing, 1: from the rows before the batch, 2 and more: from the batch
                pick = np.where(before >= np.maximum(starts, 0), before + 2, np.where((starts < 0) & (run.key is not None), 1, 0))
                carry = run.last.get(src, pa.nulls(1, c.type)).cast(c.type)
                columns.append(pa.concat_arrays([pa.nulls(1, c.type), carry, c]).take(pa.array(pick)))
            if position:
                columns.append(pa.array(np.where(starts < 0, at + run.n, at - starts) + 1))
            run.take(batch, starts)
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(scan, schema)


def rank_all(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """Position in one total order over the whole table, without a single-task window.

    Range-sorted and written once; the position is the offset of the partition (one row per
    partition, broadcast) plus the place inside it.
    """
    ordered = cut_lineage(df.orderBy(*order))
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = ordered.groupBy(F.spark_partition_id().alias("_part")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_place") + 1)
        .drop("_part", "_place", "_start")
    )


def value_sets(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """One row per key with its sorted distinct values. Repeats go before the values of a key meet, so a
    cell grows with the different values of its key only, whatever share of the rows it owns."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return distinct.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(out))
