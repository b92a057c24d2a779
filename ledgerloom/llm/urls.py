"""URL filters: a blocked Bloom filter in front of an exact hash join with the listed URLs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, written

WORDS = 8  # 64-bit words of a block: one cache line
BITS = 8  # bits set per key, all in one block


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a page's address: no scheme, query, fragment, final slash or ``.html``."""
    return F.concat(host, F.regexp_replace(path, r"(?:/|\.html)$", ""))


def _bits(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and the eight words of the mask of each key."""
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys), dtype="<u8").reshape(-1, 2)
    masks = np.zeros((len(keys), WORDS), dtype=np.uint64)
    for i in range(BITS):  # nine hash bits choose one of the block's 512
        at = (digest[:, 1] >> np.uint64(7 * i)) & np.uint64(511)
        masks[np.arange(len(keys)), (at >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (at & np.uint64(63))
    return (digest[:, 0] % np.uint64(blocks)).astype(np.int64), masks


def build_filter(listed: DataFrame, bits_per_key: int = 16, max_bytes: int = 32 << 20) -> np.ndarray:
    """Bloom filter of ``listed.entry``: an array of blocks.

    Tasks set the bits of their own keys, blocks are or-ed by block number. The filter has
    ``bits_per_key`` bits a key and never more than ``max_bytes``: a longer list only lets more false
    positives through, which the exact join removes.
    """
    listed = listed.where("entry IS NOT NULL")
    count = listed.count()
    blocks = max(1, min(-(-count * bits_per_key // 512), max_bytes // 64))
    names = [f"w{i}" for i in range(WORDS)]
    ddl = "block bigint, " + ", ".join(f"{n} bigint" for n in names)
    shape = arrow_schema(ddl)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block, masks = _bits(batch.column(0).to_pylist(), blocks)
                columns = [pa.array(block), *(pa.array(masks[:, i].view(np.int64)) for i in range(WORDS))]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)

    ored = listed.select("entry").mapInArrow(set_bits, ddl).groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])
    out = np.zeros((blocks, WORDS), dtype=np.uint64)
    for row in ored.toLocalIterator():
        out[row.block] = np.array(row[1:], dtype=np.int64).view(np.uint64)
    return out


def entries_of(host: str, path: str, lengths: list[int], whole: str) -> list[str]:
    """All entries that could fit a URL: each domain above it with each listed path length, and the
    canonical address itself."""
    domains, at = ([host] if host else []), host.find(".")
    while at >= 0:
        domains.append(host[at + 1 :])
        at = host.find(".", at + 1)
    paths = [path[:n] for n in lengths if n <= len(path)]
    return [f"={whole}", *(d + p for d in domains for p in paths)]


def probe_filter(spark: SparkSession, bloom: np.ndarray, entry: Column) -> Column:
    """Whether an entry may be in the filter (never false for one that is)."""
    spread = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf(T.BooleanType())
    def maybe(entries: pd.Series) -> pd.Series:
        block, masks = _bits(entries.tolist(), len(spread.value))
        return pd.Series(((spread.value[block] & masks) == masks).all(axis=1))

    return maybe(entry)


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule, listed_entry and verdict.

    ``listed`` has (entry, action): ``host/path`` fits that host and its subdomains where the URL's path
    starts with the entry's; ``=address`` fits one canonical address. The longest host/path entry
    decides, then the address, then ``default``. Distinct URLs are judged once: the filter names the
    entries that may be listed, and only those meet the list in a hash join on the entry. A third of
    all pages may share a host or a URL: adaptive execution splits such a join partition.

    Null URLs and URLs without ``://`` have empty host and path and get ``default``; repeated rows all
    stay; empty tables work on either side. An entry listed twice counts once (block before allow).
    Input columns called like a result column are replaced.
    """
    one_each = listed.where("entry IS NOT NULL").groupBy("entry").agg(F.max("action").alias("action"))
    one_each, _ = written(one_each, "urllist")
    path_part = F.when(~F.col("entry").startswith("="), F.length("entry") - F.instr("entry", "/") + 1)
    # a path has no more lengths than a URL has characters
    lengths = sorted(r[0] for r in one_each.select(path_part.alias("n")).distinct().where("n IS NOT NULL").collect())
    bloom = build_filter(one_each)
    spread = pages.sparkSession.sparkContext.broadcast(bloom)
    shape = arrow_schema("url string, entry string")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = spread.value
        for batch in batches:
            urls, entries = [], []
            for u, host, path, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = entries_of(host, path, lengths, whole)
                entries += found
                urls += [u] * len(found)
            if entries:
                block, masks = _bits(entries, len(blocks))
                hit = np.flatnonzero(((blocks[block] & masks) == masks).all(axis=1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([urls[i] for i in hit], pa.string()), pa.array([entries[i] for i in hit], pa.string())], schema=shape
                )

    names = ("host", "path", "rule", "listed_entry", "verdict")
    kept = [c for c in pages.columns if c not in (*names, "_address", "_rule", "_page")]
    distinct = pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    parts = distinct.select("url", host_of("url").alias("host"), path_of("url").alias("path"))
    parts = parts.select("*", canonical(F.col("host"), F.col("path")).alias("whole"))
    hits = parts.mapInArrow(probe, "url string, entry string").join(one_each, "entry")
    is_rule = ~F.col("entry").startswith("=")
    best = hits.groupBy("url").agg(
        F.max_by(F.struct("entry", "action"), F.when(is_rule, F.struct(F.length("entry"), -F.instr("entry", "/"), "entry"))).alias("_rule"),
        F.max(F.when(~is_rule, F.struct("entry", "action"))).alias("_page"),
    ).withColumnRenamed("url", "_address")
    joined = pages.select(*kept).join(best, F.col(url) == F.col("_address"), "left")
    return joined.select(
        *kept,
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col("_rule.entry").alias("rule"),
        F.col("_page.entry").alias("listed_entry"),
        F.coalesce("_rule.action", "_page.action", F.lit(default)).alias("verdict"),
    )
