"""Quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, mix64, word_hashes
from .samples import training_rows

PASSAGE = 64  #: words of a passage
HASHED = 32  #: dimensions of hashed words
CHUNK = 1 << 20  #: bytes encoded at a time

_CLASSES = np.zeros((256, 9), dtype=np.float32)  # upper, lower, digit, sentence end, other sign, bar, line, other byte, symbol
_CLASSES[65:91, 0] = 1
_CLASSES[97:123, 1] = 1
_CLASSES[48:58, 2] = 1
_CLASSES[list(b".,;:!?"), 3] = 1
_CLASSES[list(b"\"'()-[]{}/<>"), 4] = 1
_CLASSES[list(b"|"), 5] = 1
_CLASSES[list(b"\n"), 6] = 1
_CLASSES[128:, 7] = 1
_CLASSES[list(b"#$%&*+=@^_~\\`"), 8] = 1
STATS = 9 + 5
WIDTH = STATS + HASHED


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH, passages per text). Every text has at least one passage, if an empty one.

    A passage is the next ``PASSAGE`` words: shares of byte classes, word statistics, repeated words and
    neighbours, and hashed word counts. Texts are joined, so a step costs the same for many short
    texts as for one long.
    """
    joined = b" ".join(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    raw = np.frombuffer(joined, dtype=np.uint8)
    hashes = word_hashes(joined)
    gaps = np.isin(raw, np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8))
    edge = np.diff(np.concatenate([[1], gaps, [1]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(begins, first, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    per_text = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    word_at = np.arange(len(first)) - np.concatenate([[0], np.cumsum(n_words)[:-1]])[doc]
    passage = base[doc] + word_at // PASSAGE
    out = np.zeros((int(per_text.sum()), WIDTH), dtype=np.float32)
    if not len(first):
        return out, per_text
    held = np.bincount(passage, minlength=len(out))
    full = np.flatnonzero(held)
    ends = np.cumsum(held[full])
    starts = ends - held[full]
    low, high = first[starts], last[ends - 1]
    size = np.maximum(1, high - low).astype(np.float32)
    for k in range(9):
        sums = np.concatenate([[0], np.cumsum(_CLASSES[:, k][raw], dtype=np.float64)])
        out[full, k] = (sums[high] - sums[low]) / size
    n = held[full].astype(np.float32)
    letters = (last - first).astype(np.float64)
    mean = np.bincount(passage, letters, len(out))[full] / n
    spread = np.sqrt(np.maximum(0, np.bincount(passage, letters**2, len(out))[full] / n - mean**2))
    mixed = mix64(hashes ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(mixed, kind="stable")
    again = np.zeros(len(mixed), dtype=bool)
    again[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
    follows = np.zeros(len(mixed), dtype=bool)
    follows[1:] = mixed[1:] == mixed[:-1]
    repeated = np.bincount(passage, again, len(out))[full] / n
    echoed = np.bincount(passage, follows, len(out))[full] / n
    out[full, 9:STATS] = np.stack([mean / 10, spread / 10, repeated, echoed, np.log1p(n) / 4], axis=1)
    cell = passage * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64)
    out[:, STATS:] = np.bincount(cell, minlength=len(out) * HASHED).reshape(-1, HASHED) / np.maximum(held, 1)[:, None]
    return out, per_text


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class QualityModel:
    """h = tanh(W x); attention = softmax over a document's passages of w (tanh(V h) * sigmoid(U h));
    score = sigmoid(c . sum of attention * h + b). ``shift`` and ``scale`` standardise x."""

    shift: np.ndarray
    scale: np.ndarray
    W: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        bag = np.repeat(np.arange(len(counts)), counts)
        x = np.clip((x - self.shift) / self.scale, -8, 8)
        h = np.tanh(x @ self.W)
        t, g = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        e = (t * g) @ self.w
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.b[0], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "at": at, "bag": bag}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        f = self.forward(x, counts)
        d = weight * (f["p"] - y)
        dz = d[:, None] * self.c[None, :]
        dh = f["a"][:, None] * dz[f["bag"]]
        da = (f["h"] * dz[f["bag"]]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[f["bag"]])
        tg = f["t"] * f["g"]
        dt = de[:, None] * self.w[None, :] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * self.w[None, :] * tg * (1 - f["g"])
        dh += dt @ self.V.T + dg @ self.U.T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dx, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": tg.T @ de, "c": f["z"].T @ d, "b": np.array([d.sum()])}


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, attention: int = 12,
          epochs: int = 40, batch: int = 64, seed: int = 11) -> QualityModel:
    """Adam on batches of documents; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    m = QualityModel(shift, scale, draw(x.shape[1], hidden), draw(hidden, attention), draw(hidden, attention), draw(attention), draw(hidden), np.zeros(1))
    names = ("W", "V", "U", "w", "c", "b")
    one, two = ({n: np.zeros_like(getattr(m, n)) for n in names} for _ in range(2))
    at, step = np.concatenate([[0], np.cumsum(counts)]), 0
    for epoch in range(epochs):
        order = rng.permutation(len(counts))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            rows = np.concatenate([np.arange(at[k], at[k + 1]) for k in part])
            g = m.gradients(x[rows], counts[part], y[part], weight[part] / weight[part].sum())
            step += 1
            for n in names:
                grad = g[n] + 1e-4 * getattr(m, n)
                one[n] = 0.9 * one[n] + 0.1 * grad
                two[n] = 0.999 * two[n] + 0.001 * grad**2
                rate = 0.01 * (1 - epoch / epochs) + 1e-4
                setattr(m, n, getattr(m, n) - rate * (one[n] / (1 - 0.9**step)) / (np.sqrt(two[n] / (1 - 0.999**step)) + 1e-8))
    return m


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, per_class: int = 1000
) -> QualityModel | None:
    """Learn from at most ``per_class`` documents of either label, passages encoded by Spark.

    Returns None where no document is labelled; scores are then 0.5.
    """
    rows, weight = training_rows(docs, labels, label, modulus, held_out, per_class)
    ddl = "id string, label int, n int, x array<float>"
    shape = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, n = encode([(text or "").encode()])
                cells = [[str(key)], [y], [int(n[0])], [x.reshape(-1).tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cells, shape, strict=True)], schema=shape)

    found = sorted(rows.select(rows.columns[0], "text", "label").mapInArrow(run, ddl).collect(), key=lambda r: (r.id, r.n, r.x))
    if not found:
        return None
    x = np.concatenate([np.array(r.x, dtype=np.float32).reshape(-1, WIDTH) for r in found])
    y = np.array([r.label for r in found], dtype=float)
    return train(x, np.array([r.n for r in found]), y, np.where(y == 1, weight[1], weight[0]) ** 0.5)


def score_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` plus a struct ``out``: score, passages, and the largest attention weight with its passage.

    Every passage of every text is encoded and weighed. Empty and null texts are one empty passage;
    repeated rows score alike; a column called ``out`` is replaced; nothing is shuffled.
    """

    def scored(texts: pd.Series) -> pd.DataFrame:
        score, n, top, place = [], [], [], []
        for part in _chunks([(t or "").encode() for t in texts]):
            x, counts = encode(part)
            if model is None:
                score += [0.5] * len(part)
                top += [1.0] * len(part)
                place += [0] * len(part)
            else:
                f = model.forward(x, counts)
                score += f["p"].tolist()
                peaks = np.maximum.reduceat(f["a"], f["at"])
                top += peaks.tolist()
                at_peak = np.flatnonzero(f["a"] == peaks[f["bag"]])
                _, firsts = np.unique(f["bag"][at_peak], return_index=True)
                place += (at_peak[firsts] - f["at"]).tolist()
            n += counts.tolist()
        return pd.DataFrame({"score": score, "n_passages": n, "attention": top, "passage": place})

    kind = T.StructType.fromDDL("score double, n_passages int, attention double, passage int")
    return docs.withColumn(out, F.pandas_udf(scored, kind)(F.col(text)))
