"""Suffix-array dedup: blockwise suffix sorting of all texts with a difference cover.

A difference cover D modulo V has, for any two positions, an offset below V that takes both to positions whose
place in their document is in D modulo V. So two suffixes that share ``length`` bytes reach, after the same
few bytes, two *cover-sampled* suffixes that share the rest. Sorted cover samples therefore decide all others:

1. Texts are packed into chunks, one table bucketed by chunk, so that texts are never shuffled again.
2. Seeds: the first ``length - V + 1`` bytes of every sampled suffix, as hashes packed by bucket, tell which
   samples can be part of a match with another document at all; the others are not sorted.
3. Ranks: the samples left are dealt into blocks; a block is sorted to ``length`` bytes, and the common prefix of
   neighbours gives the rank of every sample at every depth from ``length`` down.
4. Suffixes: within a block, one bucket of suffixes at a time (those that reach their sample after d bytes,
   d = 0 ... V - 1) is sorted by these d bytes, ties going to the sample's rank at depth ``length - d``. Each run of
   equal suffixes is told the smallest document that starts one.

Blocks are made in ``PASSES`` passes, each of which takes its share of the samples through one shuffle and leaves
two bytes a sample, so that scratch disk and memory stay bounded.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _ensure_checkpoint_dir
from .common import arrow_schema, drop_written, mix64, written

V, COVER = 13, (0, 1, 3, 9)  #: every difference modulo 13 is one of two members
LAST = (1 << 63) - 1  # stands for a null document id: it comes after every other
CHUNK = 4 << 20  #: bytes of text in a chunk; a longer text is a chunk of its own
BUCKET_SAMPLES = 4_000_000  #: cover samples that a task of the seed step holds, on average
PASSES = 2  #: rounds in which the blocks are sorted
STEP = 1 << 18  #: samples hashed at a time

CHUNKS = "chunk bigint, docs binary, ends binary, prints binary, body binary"
SEEDS = "bucket int, chunk bigint, width int, seeds binary"
CHOSEN = "chunk bigint, at binary, copies binary"
BLOCKS = "bucket int, chunk bigint, samples binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, starts array<bigint>, lengths array<bigint>, kept binary, kept_sha256 string"

_SAMPLE = np.dtype([("a", "<u8"), ("b", "<u4"), ("l1", "<u8"), ("l2", "<u4"), ("r1", "<u8"), ("r2", "<u4"), ("doc", "<i8"), ("nl", "u1"), ("nr", "u1")])


# ---- chunks ----------------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = arrow_schema(CHUNKS)
    number = TaskContext.get().partitionId() << 33
    docs, bodies, size = [], [], 0

    def chunk():
        ends = np.cumsum([len(b) for b in bodies], dtype="<i8").tobytes()
        prints = b"".join(xxhash.xxh3_128_digest(b) for b in bodies)
        values = [number, np.array(docs, "<i8").tobytes(), ends, prints, b"".join(bodies)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape, strict=True)], schema=shape)

    for batch in batches:
        for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (body.as_py() or "").encode()
            if bodies and size + len(raw) > CHUNK:
                yield chunk()
                number, docs, bodies, size = number + 1, [], [], 0
            docs.append(doc)
            bodies.append(raw)
            size += len(raw)
    if bodies:
        yield chunk()


@contextmanager
def _files_go(spark: SparkSession):
    """Shuffle files of a finished write are removed at once, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _chunk_table(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str, str]:
    """The chunks as a table bucketed by chunk in the shared folder: joins by chunk move only their other side."""
    spark = docs.sparkSession
    _ensure_checkpoint_dir(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    name = f"suffixchunks_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LAST)).alias("doc"), F.col(f"`{text}`").alias("text"))
    (
        rows.mapInArrow(_pack, CHUNKS).write.format("parquet").option("path", path).option("compression", "zstd")
        .bucketBy(max(24, math.ceil(size / (4 * CHUNK))), "chunk").saveAsTable(name)
    )
    return spark.table(name), name, path


# ---- cover samples ---------------------------------------------------------------------------


def _padded(body: bytes) -> np.ndarray:
    """The text between zero margins of 64 bytes."""
    raw = np.zeros(len(body) + 128, dtype=np.uint8)
    raw[64 : 64 + len(body)] = np.frombuffer(body, dtype=np.uint8)
    return raw


def _hashed(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of raw[at : at + width]."""
    words = -(-width // 8)
    windows = np.lib.stride_tricks.sliding_window_view(raw, words * 8)
    one, two = (np.empty(len(at), dtype=np.uint64) for _ in range(2))
    for lo in range(0, len(at), STEP):
        bytes_ = windows[at[lo : lo + STEP]]
        bytes_[:, width:] = 0
        w = bytes_.view("<u8")
        a, b = np.full(len(w), width, dtype=np.uint64), np.full(len(w), 7, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words):
                a = mix64(a + w[:, k] * np.uint64(0x9E3779B97F4A7C15))
                b = (b ^ w[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
                b ^= b >> np.uint64(29)
        one[lo : lo + STEP], two[lo : lo + STEP] = a, b
    return one, two


def _samples(ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the cover-sampled suffixes that hold a whole seed, number of the document of each)."""
    sizes = np.diff(ends, prepend=0)
    parts = []
    for member in COVER:
        counts = np.maximum((sizes - seed - member) // V + 1, 0)
        owner = np.repeat(np.arange(len(ends)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        parts.append(((ends - sizes + member)[owner] + V * nth, owner))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _joint(one: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of a seed's hash as one number."""
    bucket = (one & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    return (bucket << np.uint64(32)) | (one >> np.uint64(32))


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _seed_rows(seed: int, buckets: int):
    """The different seeds of each chunk, sorted within their bucket and packed as gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(SEEDS)
        for batch in batches:
            for chunk, ends, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ends", "body")), strict=True):
                at, _ = _samples(np.frombuffer(ends, "<i8"), seed)
                keys = np.sort(_joint(_hashed(_padded(body), at + 64, seed)[0], buckets))
                keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
                bounds, rest = _bounds(keys, buckets), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
                rows = []
                for k in range(buckets):
                    own = rest[bounds[k] : bounds[k + 1]]
                    if len(own):
                        gaps = np.diff(own, prepend=0)
                        width = max(1, -(-int(gaps.max()).bit_length() // 8))
                        rows.append((k, chunk, width, gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return run


def _unpacked(width: int, packed: bytes) -> np.ndarray:
    gaps = np.zeros((len(packed) // width, 4), dtype=np.uint8)
    gaps[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return np.cumsum(gaps.view("<u4").ravel(), dtype=np.uint32)


def _shared_seeds(group: pd.DataFrame) -> pd.DataFrame:
    """Which seeds of a bucket several chunks hold, as a bitmap per chunk."""
    lists = [_unpacked(w, s) for w, s in zip(group["width"], group["seeds"], strict=True)]
    every = np.concatenate(lists)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    hits = [np.isin(x, twice, assume_unique=True) for x in lists]
    rows = [(c, b, np.packbits(h).tobytes()) for c, b, h in zip(group["chunk"], group["bucket"], hits, strict=True) if h.any()]
    return pd.DataFrame(rows, columns=["chunk", "bucket", "hits"])


# ---- what is known of a chunk ----------------------------------------------------------------


def _chosen_rows(seed: int, buckets: int):
    """Positions of the samples of a chunk that may be part of a match with another document: their seed is in
    another chunk or in another document of this one. Documents that are copies as a whole need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(CHOSEN)
        for batch in batches:
            for row in batch.to_pylist():
                ends, docs = np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["docs"], "<i8")
                at, owner = _samples(ends, seed)
                keys = _joint(_hashed(_padded(row["body"]), at + 64, seed)[0], buckets)
                order = np.argsort(keys)
                keys = keys[order]
                fresh = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
                bounds, hit = _bounds(keys[fresh], buckets), np.zeros(len(fresh), dtype=bool)
                for h in row["hits"] or []:
                    lo, hi = bounds[h["bucket"]], bounds[h["bucket"] + 1]
                    hit[lo:hi] = np.unpackbits(np.frombuffer(h["hits"], np.uint8), count=hi - lo).astype(bool)
                if len(order):
                    own = docs[owner[order]]
                    hit |= np.minimum.reduceat(own, fresh) != np.maximum.reduceat(own, fresh)
                chosen = order[np.repeat(hit, np.diff(fresh, append=len(order)))]
                copies = np.array(sorted(row["copies"] or []), dtype="<i4")
                chosen = chosen[~np.isin(owner[chosen], copies)]
                values = [row["chunk"], np.sort(at[chosen]).astype("<i8").tobytes(), copies.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape, strict=True)], schema=shape)

    return run


def _candidates(row: dict, seed: int, length: int):
    """(ends, documents, records of the chosen samples of a chunk, their positions, which of them go to the blocks).

    Of samples that agree in all bytes that any suffix needs only those of the smallest document go there: for
    the others that document is the answer.
    """
    ends, docs, at = (np.frombuffer(row[c], "<i8") for c in ("ends", "docs", "at"))
    raw, owner = _padded(row["body"]), np.searchsorted(ends, at, side="right")
    found = np.empty(len(at), dtype=_SAMPLE)
    one, two = _hashed(raw, at + 64, seed)
    found["a"], found["b"], found["doc"] = one, two >> np.uint64(32), docs[owner]
    starts = ends - np.diff(ends, prepend=0)
    found["nl"], found["nr"] = np.minimum(at - starts[owner], V - 1), np.minimum(ends[owner] - at, length)
    # left bytes, nearest first, and right bytes behind the seed, each as a number that sorts like the bytes
    windows = np.lib.stride_tricks.sliding_window_view(raw, 12)
    before = windows[at + 64 - 12][:, ::-1].copy()
    after = windows[at + 64 + seed]
    before[np.arange(12) >= found["nl"][:, None]] = 0
    after[np.arange(12) >= found["nr"][:, None].astype(np.int64) - seed] = 0
    every = one ^ two
    for name, bytes_ in (("l", before), ("r", after)):
        found[f"{name}1"] = np.ascontiguousarray(bytes_[:, :8]).view(">u8").ravel()
        found[f"{name}2"] = np.ascontiguousarray(bytes_[:, 8:]).view(">u4").ravel()
        every = mix64(every ^ found[f"{name}1"]) + found[f"{name}2"]
    by = np.argsort(every)
    s = found[by]
    same = np.ones(max(len(s) - 1, 0), dtype=bool)
    for c in ("a", "b", "l1", "l2", "r1", "r2", "nl", "nr"):
        same &= s[c][1:] == s[c][:-1]
    fresh = np.flatnonzero(np.r_[True, ~same]) if len(s) else np.empty(0, np.int64)
    sent = np.empty(len(s), dtype=bool)
    if len(s):
        sent[by] = s["doc"] == np.repeat(np.minimum.reduceat(s["doc"], fresh), np.diff(fresh, append=len(s)))
    return ends, docs, found, at, sent


def _dealt(found: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(found["a"]) % np.uint64(blocks)).astype(np.int64)


def _block_rows(seed: int, length: int, blocks: int, number: int):
    """The samples of one pass, dealt into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(BLOCKS)
        for batch in batches:
            for row in batch.to_pylist():
                _, _, found, _, sent = _candidates(row, seed, length)
                block = _dealt(found, blocks)
                mine = np.flatnonzero(sent & (block % PASSES == number))
                mine = mine[np.argsort(block[mine], kind="stable")]
                cuts = np.flatnonzero(np.diff(block[mine])) + 1
                rows = [(int(block[p[0]]), row["chunk"], found[p].tobytes()) for p in np.split(mine, cuts) if len(p)]
                columns = zip(*rows, strict=True) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return run


# ---- blocks ----------------------------------------------------------------------------------


def _order(new: np.ndarray, one: np.ndarray, two: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row in the order, common bytes with the row before it there).

    Rows compare by ``new`` and then by ``width`` bytes held in two numbers; -1 where ``new`` differs.
    """
    by = np.lexsort((two, one, new))
    a, b = one[by], two[by]
    both = np.concatenate([(a[1:] ^ a[:-1])[:, None].astype(">u8").view(np.uint8), (b[1:] ^ b[:-1])[:, None].astype(">u4").view(np.uint8)], axis=1)
    common = np.where(both.any(axis=1), (both != 0).argmax(axis=1), width)
    common[new[by][1:] != new[by][:-1]] = -1
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    return place, np.r_[-1, common]


def sorted_suffixes(s: np.ndarray, seed: int, length: int) -> np.ndarray:
    """Bits of each sample: bit d is set if the suffix d bytes before it shares ``length`` bytes with one of a
    document with a smaller id."""
    out = np.zeros(len(s), dtype=np.uint16)
    if not len(s):
        return out
    by = np.lexsort((s["b"], s["a"]))
    fresh = np.r_[True, (s["a"][by][1:] != s["a"][by][:-1]) | (s["b"][by][1:] != s["b"][by][:-1])]
    named = np.empty(len(s), dtype=np.int64)
    named[by] = np.cumsum(fresh)
    right, right_common = _order(named, s["r1"], s["r2"], length - seed)
    left, left_common = _order(np.zeros(len(s), dtype=np.int64), s["l1"], s["l2"], V - 1)
    for d in range(V):  # one bucket of suffixes at a time
        here = np.flatnonzero((s["nl"] >= d) & (s["nr"] >= length - d))
        if not len(here):
            continue
        rank = np.cumsum(right_common < length - d - seed)[right[here]]  # the sample's rank at depth length - d
        before = np.cumsum(left_common < d)[left[here]] if d else np.zeros(len(here), dtype=np.int64)
        joint = rank * (len(s) + 1) + before
        order = np.argsort(joint, kind="stable")
        starts = np.flatnonzero(np.r_[True, joint[order][1:] != joint[order][:-1]])
        doc = s["doc"][here][order]
        first = np.repeat(np.minimum.reduceat(doc, starts), np.diff(starts, append=len(doc)))
        out[here[order[doc > first]]] |= np.uint16(1 << d)
    return out


def _solved(seed: int, length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, dtype=_SAMPLE) for x in group["samples"]]
        bits = sorted_suffixes(np.concatenate(parts), seed, length)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        rows = [(c, b, x.tobytes()) for c, b, x in zip(group["chunk"], group["bucket"], np.split(bits, cuts), strict=True) if x.any()]
        return pd.DataFrame(rows, columns=["chunk", "block", "bits"])

    return run


# ---- documents -------------------------------------------------------------------------------


def _documents(seed: int, length: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(RESULT)
        for batch in batches:
            for row in batch.to_pylist():
                ends, docs, found, at, sent = _candidates(row, seed, length)
                copy = np.zeros(len(ends), dtype=bool)
                copy[np.frombuffer(row["copies"], "<i4")] = True
                bits = np.zeros(len(found), dtype=np.uint16)
                block = _dealt(found, blocks)
                mine = np.flatnonzero(sent)
                mine = mine[np.argsort(block[mine], kind="stable")]
                dealt = block[mine]
                for x in row["solved"] or []:
                    lo, hi = np.searchsorted(dealt, (x["block"], x["block"] + 1))
                    bits[mine[lo:hi]] = np.frombuffer(x["bits"], "<u2")
                # samples that agree with one of a smaller document in this chunk: each of their suffixes goes
                bits[~sent] = (1 << V) - 1
                edge = np.zeros(len(row["body"]) + 1, dtype=np.int32)
                for d in range(V):
                    gone = at[((bits >> d) & 1).astype(bool) & (found["nl"] >= d) & (found["nr"] >= length - d)] - d
                    edge += np.bincount(gone, minlength=len(edge)).astype(np.int32)
                    edge -= np.bincount(gone + length, minlength=len(edge)).astype(np.int32)
                covered = np.cumsum(edge[:-1]) > 0
                starts = ends - np.diff(ends, prepend=0)
                rows = []
                for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    gone = np.ones(hi - lo, dtype=bool) if copy[k] and hi - lo >= length else covered[lo:hi]
                    step = np.diff(gone, prepend=False, append=False).nonzero()[0]
                    body = row["body"][lo:hi]
                    kept = b"".join(body[a:b] for a, b in zip([0, *step[1::2].tolist()], [*step[::2].tolist(), hi - lo], strict=True))
                    doc = int(docs[k])
                    spans = step[::2].tolist(), (step[1::2] - step[::2]).tolist()
                    rows.append((None if doc == LAST else doc, hi - lo, hi - lo - len(kept), len(spans[0]), *spans, kept, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return run


def _copies(chunks: DataFrame) -> DataFrame:
    """(chunk, copies): numbers of the documents whose whole text a document with a smaller id has. Groups
    are made of 128-bit text hashes; sums combine inside tasks, and no text is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs, prints in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                halves = np.frombuffer(prints, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(halves), chunk)), pa.array(np.arange(len(halves), dtype=np.int32)), pa.array(np.frombuffer(docs, "<i8")),
                     pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], schema=arrow_schema(rows),
                )

    rows = "chunk bigint, k int, doc bigint, h1 bigint, h2 bigint"
    prints = chunks.select("chunk", "docs", "prints").mapInArrow(run, rows)
    firsts = prints.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    later = prints.join(firsts, ["h1", "h2"]).where("doc > first")
    return later.groupBy("chunk").agg(F.collect_list("k").alias("copies"))


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """Remove every byte that lies in a ``length``-byte string which also starts in a document with a smaller id.

    Texts are UTF-8 bytes (a null text is empty) and matches never cross documents. Strings are judged on the
    input; overlaps count. Returns one row per input row: doc_id, n_bytes, n_removed, n_spans, the removed runs as
    ``starts`` and ``lengths``, the remaining bytes as ``kept`` (a cut may split a character, so they are bytes)
    and their SHA-256. Rows of one id are one document and never remove each other; null ids are one document
    after all others. Texts shorter than ``length`` lose nothing. Other columns are not carried, whatever their
    names; an empty table gives no rows. ``length`` must be 26 or more.
    """
    if length < 2 * V:
        raise ValueError(f"length must be at least {2 * V}")
    spark, seed = docs.sparkSession, length - V + 1
    with _files_go(spark):
        chunks, name, place = _chunk_table(docs, key, text)
        size = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        buckets = max(64, math.ceil(size * len(COVER) / V / BUCKET_SAMPLES))
        shared = (
            chunks.select("chunk", "ends", "body").mapInArrow(_seed_rows(seed, buckets), SEEDS)
            .groupBy("bucket").applyInPandas(_shared_seeds, "chunk bigint, bucket int, hits binary")
        )
        hits = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hits")).alias("hits"))
        known = hits.join(_copies(chunks), "chunk", "full")
        with_hits = chunks.join(known, "chunk", "left").select("chunk", "docs", "ends", "body", "hits", "copies")
        chosen, chosen_at = written(with_hits.mapInArrow(_chosen_rows(seed, buckets), CHOSEN), "suffixchosen")
        known = chunks.join(chosen, "chunk").select("chunk", "docs", "ends", "body", "at", "copies")
        blocks = buckets * PASSES
        solved, scratch = None, [chosen_at]
        for number in range(PASSES):
            dealt = known.mapInArrow(_block_rows(seed, length, blocks, number), BLOCKS)
            part = dealt.groupBy("bucket").applyInPandas(_solved(seed, length), "chunk bigint, block int, bits binary")
            part, at = written(part, "suffixbits")
            scratch.append(at)
            solved = part if solved is None else solved.unionByName(part)
        by_chunk = solved.groupBy("chunk").agg(F.collect_list(F.struct("block", "bits")).alias("solved"))
        out, _ = written(known.join(by_chunk, "chunk", "left").mapInArrow(_documents(seed, length, blocks), RESULT), "suffixkept")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for at in [place, *scratch]:
        drop_written(spark, at)
    return out
