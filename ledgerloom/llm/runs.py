"""Runs of repeated word sequences: common-extension queries over a difference cover, on harmonic grids.

A run of period q and length 2q or more holds two neighbours of the grid 0, q, 2q, ... of its document. So all
runs come from the pairs (kq, (k + 1)q) of every q, of which there are n log n: how far the two places agree to
the right and to the left gives the run. Such a common extension compares at most V - 1 words, until both places are
in the cover sample; between sampled places it is a range minimum over the sorted sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

V, COVER = 7, (0, 1, 3)  #: every difference modulo 7 is one of two members
WORDS = 1 << 18  #: words handled together; a longer document is handled alone
PAIRS = 1 << 21  #: grid pairs looked at together
SHORTEST = 12


def _ranked(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of rows of numbers below 2**31, in their order."""
    rank, rest = columns[0].astype(np.uint64), columns[1:]
    while True:
        top = int(rank.max()) + 1
        while rest and top * (wide := int(rest[0].max()) + 1) < 1 << 64:
            rank, top, rest = rank * np.uint64(wide) + rest[0].astype(np.uint64), top * wide, rest[1:]
        order = np.argsort(rank)
        fresh = np.r_[True, rank[order][1:] != rank[order][:-1]]
        rank = np.empty(len(order), dtype=np.uint64)
        rank[order] = np.cumsum(fresh)
        if not rest:
            return rank.astype(np.int64)


class Extension:
    """Length of the longest common prefix of two suffixes of one sequence of numbers, for arrays of places.

    Places one behind the sequence, and pairs of different places only. Only suffixes at cover-sampled places are sorted, by blocks of V
    words, then 2V, 4V, ...
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        tail = int(ids.max(initial=0)) + 1 + np.arange(3 * V)  # a pair never agrees behind the end
        self.ids = np.concatenate([ids, tail])
        at = np.arange(n + V)
        self.at = at[np.isin(at % V, COVER)]
        self.place = np.full(len(self.ids) + V, -1)
        self.place[self.at] = np.arange(len(self.at))
        self.shift = np.array([[next(d for d in range(V) if (i + d) % V in COVER and (j + d) % V in COVER) for j in range(V)] for i in range(V)])
        m = len(self.at)
        ranks = [_ranked(*(self.ids[self.at + k] for k in range(V)))]
        steps = []
        while ranks[-1].max() < m and V << len(steps) < n + V:
            further = np.searchsorted(self.at, self.at + (V << len(steps)))
            steps.append(further)
            ranks.append(_ranked(ranks[-1], np.append(ranks[-1], 0)[further]))
        self.rank = ranks[-1] - 1
        order = np.argsort(ranks[-1])
        # blocks that neighbours in the order share, from the longest power of two down
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(m - 1, dtype=np.int32)
        for k in range(len(steps) - 1, -1, -1):
            known = np.append(ranks[k], 0)
            same = (known[a] == known[b]) & (known[a] > 0)
            common[same] += 1 << k
            after = np.append(steps[k], m)
            a[same], b[same] = after[a[same]], after[b[same]]
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _words(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common words, compared one by one, up to ``most`` (below V)."""
        length = np.zeros(len(i), dtype=np.int64)
        live = np.arange(len(i))
        for k in range(V):
            live = live[most[live] > k]
            live = live[self.ids[i[live] + k] == self.ids[j[live] + k]]
            if not len(live):
                break
            length[live] = k + 1
        return length

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = self.shift[i % V, j % V]
        length = self._words(i, j, shift)
        live = np.flatnonzero(length == shift)
        if not len(live):
            return length
        i, j = i[live] + shift[live], j[live] + shift[live]
        a, b = self.rank[self.place[i]], self.rank[self.place[j]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.log2(hi - lo).astype(np.int64)
        level -= (1 << level) > hi - lo
        blocks = np.empty(len(live), dtype=np.int64)
        for k in np.unique(level):
            own = level == k
            blocks[own] = np.minimum(self.least[k][lo[own]], self.least[k][hi[own] - (1 << k)])
        i, j = i + blocks * V, j + blocks * V
        length[live] += blocks * V + self._words(i, j, np.full(len(live), V))
        return length


def find_runs(ids: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of several documents, by document, start and period.

    ``ids`` are the words of the documents one after the other; no two documents share a number. A run is as
    long as it keeps its smallest period, has twice that length at least, and ``shortest`` words.
    """
    n, out = len(ids), []
    right, left = Extension(ids), Extension(ids[::-1])
    first = np.cumsum(sizes) - sizes
    # one row for each period of each document; a period has (size - 1) // period pairs of grid neighbours
    doc = np.repeat(np.arange(len(sizes)), sizes // 2)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(sizes // 2) - sizes // 2, sizes // 2) + 1
    pairs = (sizes[doc] - 1) // period
    ends = np.cumsum(pairs)
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        count = pairs[lo:hi]
        row = np.repeat(np.arange(lo, hi), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        a = first[doc[row]] + nth * period[row]
        same = np.flatnonzero(ids[a] == ids[a + period[row]])
        row, a = row[same], a[same]
        p = period[row]
        b = a + p
        start, end = a - left(n - a, n - b), b + right(a, b)
        good = end - start >= np.maximum(2 * p, shortest)
        out.append(np.unique(np.stack([doc[row][good], start[good], end[good], p[good]], axis=1), axis=0))
        lo = hi
    found = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 4), dtype=np.int64)
    # multiples of a run's period give the same run: the smallest period comes first
    if len(found):
        found = found[np.r_[True, (found[1:, :3] != found[:-1, :3]).any(axis=1)]]
    found[:, 2] -= found[:, 1]
    found[:, 1] -= first[found[:, 0]]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _documents(texts: list[str | None], shortest: int) -> Iterator[tuple[int, list, str]]:
    """(number of words, runs, text without repeats) of each text, in order; many are looked at together."""
    def solved(block: list[list[bytes]]):
        long_enough = [k for k, w in enumerate(block) if len(w) >= shortest]
        runs: dict[int, list] = {}
        if long_enough:
            ids, base = [], 0
            for k in long_enough:
                known: dict[bytes, int] = {}
                ids.append(np.array([known.setdefault(w, len(known)) for w in block[k]], dtype=np.int64) + base)
                base += len(known)
            for d, *run in find_runs(np.concatenate(ids), np.array([len(x) for x in ids]), shortest).tolist():
                runs.setdefault(long_enough[d], []).append(run)
        for k, words in enumerate(block):
            own = runs.get(k, [])
            if own:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for s, n, q in own:
                    edge[s + q] += 1
                    edge[s + n] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            yield len(block[k]), own, b" ".join(words).decode()

    block, size = [], 0
    for text in texts:
        words = (text or "").encode().split()
        if block and size + len(words) > WORDS:
            yield from solved(block)
            block, size = [], 0
        block.append(words)
        size += len(words)
    yield from solved(block)


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def word_runs(docs: DataFrame, text: str = "text", out: str = "runs", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with a column ``out``: struct<n_words, runs array<struct<start, length, period>>, kept string>.

    Words are split at the six ASCII white-space characters and numbered from 0. A run is a stretch of
    ``shortest`` words or more with smallest period q and length 2q or more that no neighbouring word extends; ``runs``
    are in order of start and period. ``kept`` is the text without the words that any run holds after its first
    q, joined by single spaces. A null or empty text has no words, no runs and an empty ``kept``. Rows are
    judged each for itself: no shuffle, repeated rows get equal results, an empty table stays empty. Other columns
    pass unchanged; an input column called ``out`` is replaced.
    """
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in _RUN.names]))), ("kept", pa.string())])

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("kept", T.StringType())]))
    def judged(texts: pa.Array) -> pa.Array:
        rows = _documents(texts.to_pylist(), shortest)
        return pa.array([{"n_words": n, "runs": [dict(zip(_RUN.names, r, strict=True)) for r in runs], "kept": kept} for n, runs, kept in rows][: len(texts)], kind)

    return docs.withColumn(out, judged(F.col(f"`{text}`").cast("string")))
