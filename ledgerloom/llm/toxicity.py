"""Toxicity: a lexicon learned from labels, Levenshtein automata over its trie, context windows."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, written
from .samples import training_rows

EDGES = "\"'.,;:!?*$%&#()[]{}<>|/\\-_+=~`@^«»“”„‘’…"
QUOTES = frozenset("\"«»“”„‘’")
LOOKALIKES = str.maketrans("$@!013457", "saioieast")  #: signs and digits that stand for letters
FRONT, BACK = ("".join(c for c in EDGES if c not in signs) for signs in ("$@!", "$@"))
QUOTED = (0.25, 0.0, 0.5, 0.75, 1.0)  #: what a hit inside quotation marks may count; one is learned
SHINGLE, HASHES = 5, 4  #: words and min-hashes by which training texts are near copies
PREFIXES = range(4, 8)  #: lengths of word beginnings that may become terms
FAMILY = 5  #: so many learned words must share a beginning for it to become a term
WINDOW = 6  #: words on either side that make up a hit's context
CACHE = 400_000  #: words remembered per worker; beyond it the memory starts anew


# ---- lexicon trie and automaton ------------------------------------------------------------------


class Lexicon:
    """Terms in a trie, read by the deterministic form of their Levenshtein automata.

    A state of the automaton is the set of (trie node, edits used, letter due) that the letters read so far can
    reach; a letter is due in the middle of two swapped ones, which are one edit. States and their transitions are built when first needed and kept, so a word costs
    one dictionary step per letter, and most words leave the automaton after a few. ``terms``
    maps a term to its weight; a term that ends in ``*`` accepts every word that begins with it. Terms of
    five letters and more allow one edit, of ten and more two, never in the first letter;
    beginnings allow none.
    """

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int, bool] | None] = [None]  # term, edits allowed, is a beginning
        self.budget = [0]  # most edits that any term below a node allows
        for term in sorted(terms):
            word, opens = term.rstrip("*"), term.endswith("*")
            allowed = 0 if opens else min(2, len(word) // 5)
            at = 0
            for letter in word:
                if letter not in self.children[at]:
                    self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.budget.append(0)
                at = self.children[at][letter]
                self.budget[at] = max(self.budget[at], allowed)
            self.ends[at] = (term, allowed, opens)
        self.weights = terms
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._moves: list[dict[str, int]] = []
        self._found: list[tuple[tuple[str, int] | None, tuple[str, int] | None]] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, reached: set[tuple[int, int, str]]) -> int:
        """Number of a state; a letter may be missing from the word after every node but the root."""
        reached, todo = set(reached), list(reached)
        while todo:
            node, used, due = todo.pop()
            if node and not due and used < self.budget[node]:
                for child in self.children[node].values():
                    if used < self.budget[child] and (child, used + 1, "") not in reached:
                        reached.add((child, used + 1, ""))
                        todo.append((child, used + 1, ""))
        known = frozenset(reached)
        if known not in self._ids:
            self._ids[known] = len(self._sets)
            self._sets.append(known)
            self._moves.append({})
            at = [(n, used) for n, used, due in known if not due and self.ends[n]]
            whole = [(used, self.ends[n][0]) for n, used in at if not self.ends[n][2] and used <= self.ends[n][1]]
            opens = [(used, self.ends[n][0]) for n, used in at if self.ends[n][2] and used == 0]
            best = lambda found: min(found)[::-1] if found else None
            self._found.append((best(whole), best(opens)))
        return self._ids[known]

    def _move(self, state: int, letter: str) -> int:
        reached = set()
        for node, used, due in self._sets[state]:
            if due:
                if letter == due:
                    reached.add((node, used, ""))
                continue
            for c, child in self.children[node].items():
                cost = used + (c != letter)
                if cost == used or (node and cost <= self.budget[child]):
                    reached.add((child, cost, ""))
                swapped = self.children[child].get(letter) if node and c != letter else None
                if swapped is not None and used < self.budget[swapped]:
                    reached.add((swapped, used + 1, c))
            if node and used < self.budget[node]:
                reached.add((node, used + 1, ""))  # a letter too many
        self._moves[state][letter] = out = self._state(reached) if reached else -1
        return out

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term that accepts the word."""
        state, opening = self.start, None
        for letter in word:
            step = self._moves[state].get(letter)
            state = self._move(state, letter) if step is None else step
            if state < 0:
                return opening
            opening = self._found[state][1] or opening
        whole = self._found[state][0]
        return whole if whole and (whole[1] == 0 or not opening) else opening


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def unmasked(word: str) -> str | None:
    """The word with letters for the signs and digits that look like them, or None where it has none."""
    core = word.lower().lstrip(FRONT).rstrip(BACK)
    plain = core.translate(LOOKALIKES)
    return plain if plain != core and any(c.isalpha() for c in core) else None


def search(lexicon: Lexicon, word: str) -> tuple[str, int, str] | None:
    """(term, edits, the spelling that it accepts) of the nearest term. Look-alike signs make one edit more; a word with
    several of them has to spell a term without other edits, as too few of its letters are certain."""
    plain = bare(word)
    found = lexicon.find(plain) if plain else None
    best = (*found, plain) if found else None
    if (best is None or best[1] > 1) and (form := unmasked(word)):
        other = lexicon.find(form)
        signs = sum(ord(c) in LOOKALIKES for c in word.lower().lstrip(FRONT).rstrip(BACK))
        if other and (signs == 1 or not other[1]) and (best is None or other[1] + 1 < best[1]):
            best = (other[0], other[1] + 1, form)
    return best


def inside_quotes(words: list[str], at: int) -> bool:
    """Does the quotation mark nearest to a word on its left open, and the nearest on its right close? Marks up to
    ``WINDOW`` words away count; a mark on the other side of a word, as in ``"article"``, ends a quotation."""
    sides = lambda w: (w[: len(w) - len(w.lstrip(EDGES))], w[len(w.rstrip(EDGES)) :])
    own = sides(words[at])
    for side, way in ((0, -1), (1, 1)):
        marked = bool(QUOTES & set(own[side]))
        i = at + way
        while not marked and 0 <= i < len(words) and abs(i - at) <= WINDOW:
            near = sides(words[i])
            if QUOTES & set(near[1 - side]) and near[0] != words[i]:
                return False
            marked = bool(QUOTES & set(near[side]))
            i += way
        if not marked:
            return False
    return True


@dataclass
class ToxicityModel:
    """Terms with weights, words known to be harmless, and the weights of the document features."""

    terms: dict[str, float] = field(default_factory=dict)
    harmless: frozenset = frozenset()
    bias: float = -4.0
    slopes: tuple = (3.0, 1.0, 0.5)
    quoted: float = 0.25  #: what a hit inside quotation marks counts

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.lexicon = model, Lexicon(model.terms)
        self._seen: dict[str, tuple[str, int] | None] = {}

    def _hit(self, word: str) -> tuple[str, int] | None:
        if len(self._seen) >= CACHE:
            self._seen.clear()
        found = search(self.lexicon, word)
        if found and found[1] and found[2] in self.model.harmless:
            found = None
        self._seen[word] = found and found[:2]
        return self._seen[word]

    def hits(self, text: str) -> list[tuple[str, int, bool]]:
        """(term, edits, inside quotation marks) of every hit, in order."""
        words = text.split()
        seen = self._seen
        out = []
        for i, word in enumerate(words):
            found = seen[word] if word in seen else self._hit(word)
            if found:
                out.append((*found, inside_quotes(words, i)))
        return out

    def features(self, hits: list[tuple[str, int, bool]], quoted: float | None = None) -> list[float]:
        """Weight of exact hits, of misspelled ones, and of beginnings; quoted hits count ``quoted``, or as learned."""
        quoted = self.model.quoted if quoted is None else quoted
        sums = [0.0, 0.0, 0.0]
        for term, edits, inside in hits:
            kind = 2 if term.endswith("*") else 1 if edits else 0
            sums[kind] += self.model.terms[term] * (quoted if inside else 1.0)
        return [math.log1p(s) for s in sums]

    def score(self, hits: list[tuple[str, int, bool]]) -> float:
        z = self.model.bias + sum(a * b for a, b in zip(self.model.slopes, self.features(hits), strict=True))
        return 1 / (1 + math.exp(-z))


# ---- learning --------------------------------------------------------------------------------------


def _evidence(k: int, c: int, share: float) -> float:
    """Log likelihood gained by giving a word its own share of toxic documents."""
    n = k + c
    return k * math.log(k / n / share) + (c * math.log(c / n / (1 - share)) if c else 0.0)


def _counted(rows: DataFrame, features) -> DataFrame:
    """(feature, toxic documents, other documents), summed inside each task first."""
    ddl = "feature string, toxic bigint, clean bigint"
    shape = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(features(text or ""))
        names = list(toxic.keys() | clean.keys())
        columns = [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=shape)

    found = rows.select("text", "label").mapInArrow(run, ddl)
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _words_and_beginnings(text: str) -> set[str]:
    words = {bare(w) for w in text.split()}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


@F.udf(T.ArrayType(T.LongType()))
def _min_hashes(text: str) -> list[int]:
    """Smallest hashes of a whole text's word shingles; a shorter text is one shingle."""
    words = [bare(w) for w in (text or "").split()]
    shingles = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    crc = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in shingles], np.uint64)
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)[:HASHES]
    mixed = crc[:, None] * factors[None, :]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)
    return [int(x) for x in mixed.min(axis=0)]


def one_of_each(rows: DataFrame) -> DataFrame:
    """The sample (text, label, hashes) without near copies: of the texts of a label that share a min-hash one stays.

    Otherwise a harmful text copied forty times would make every one of its words a term. Two texts at a
    similarity of 0.8 share one of four min-hashes 998 times of 1,000; unrelated texts share none.
    """
    for k in range(HASHES):
        first = F.min_by(F.struct("text", "hashes"), F.coalesce("text", F.lit(""))).alias("one")
        rows = rows.groupBy("label", F.col("hashes")[k].alias("_hash")).agg(first).select("one.text", "label", "one.hashes")
    return rows.select("text", "label")


def learn_terms(rows: DataFrame, most: int = 5000) -> dict[str, float]:
    """Words, and beginnings of word families, that mark toxic documents beyond chance. ``most`` bounds the model:
    so many candidates at most, the ones in most toxic documents of the sample.

    The bar rises with the number of features in as many documents, so that hardly one passes by luck.
    """
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    share = n_toxic / (n_toxic + n_clean)
    counts, _ = written(_counted(rows, _words_and_beginnings).where("feature NOT IN ('', '*')"), "toxicterms")
    spread = counts.groupBy((F.col("toxic") + F.col("clean")).alias("docs")).count().collect()
    as_frequent = lambda n: sum(r["count"] for r in spread if r.docs >= n)
    likely = (F.col("toxic") >= 3) & (F.col("toxic") / n_toxic >= 20 * F.greatest("clean", F.lit(0.5)) / n_clean)
    found = counts.where(likely).orderBy(F.desc("toxic"), "feature").limit(most).collect()
    passed = {
        r.feature: (r.toxic, r.clean)
        for r in found
        if _evidence(r.toxic, r.clean, share) > math.log(as_frequent(r.toxic + r.clean)) + 3
    }
    whole = [w for w in passed if not w.endswith("*")]
    families: set[str] = set()
    for p in sorted((p for p in passed if p.endswith("*")), key=lambda p: (-_evidence(*passed[p], share), -len(p), p)):
        members = sum(w.startswith(p[:-1]) for w in whole)
        apart = not any(p.startswith(q[:-1]) or q.startswith(p[:-1]) for q in families)
        if apart and (members >= FAMILY or members == 0):
            families.add(p)
    kept = families | {w for w in whole if not any(w.startswith(p[:-1]) for p in families)}
    weight = lambda k, c: math.log((k + 0.5) / n_toxic) - math.log((c + 0.5) / n_clean)
    return {t: weight(*passed[t]) for t in kept}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60) -> tuple[float, tuple]:
    """Weighted, slightly regularised logistic regression by Newton steps; slopes are not negative."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2 * w.sum() / len(w)] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        beta[1:] = np.maximum(beta[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), tuple(map(float, beta[1:]))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2, per_class: int = 3000
) -> ToxicityModel:
    """Learn terms, harmless look-alikes, feature weights and what a quoted hit counts from at most ``per_class``
    documents of either label. Without both labels the model has no terms and every score is low."""
    rows, weight = training_rows(docs, labels, label, modulus, held_out, per_class)
    drawn, _ = written(rows.select("text", "label", _min_hashes("text").alias("hashes")), "toxicdrawn")
    rows, _ = written(one_of_each(drawn), "toxicsample")
    terms = learn_terms(rows)
    if not terms:
        return ToxicityModel()
    sizes, left = ({r["label"]: r["count"] for r in t.groupBy("label").count().collect()} for t in (drawn, rows))
    weight = {v: weight[v] * sizes[v] / left[v] for v in left}  # a text that stays stands for its copies too
    lexicon = Lexicon(terms)
    similar = _counted(rows, lambda text: {f[2] for w in set(text.split()) if (f := search(lexicon, w)) and f[1]})
    # a spelling is harmless where a larger share of the clean texts has it than of the toxic ones
    harmless = frozenset(r.feature for r in similar.where(F.col("clean") * left[1] > F.col("toxic") * left[0]).collect())
    scorer = ToxicityModel(terms, harmless).scorer()

    def measure(text: str) -> list[list[float]]:
        hits = scorer.hits(text or "")
        return [scorer.features(hits, q) for q in QUOTED]

    measured = F.udf(measure, T.ArrayType(T.ArrayType(T.DoubleType())))
    seen = sorted((r.label, r.x) for r in rows.select(measured("text").alias("x"), "label").collect())  # the bounded sample
    y = np.array([r[0] for r in seen], dtype=float)
    w = np.where(y == 1, weight[1], weight[0])
    fits = []
    for at, quoted in enumerate(QUOTED):
        x = np.array([r[1][at] for r in seen])
        bias, slopes = _logistic(x, y, w)
        z = bias + x @ np.array(slopes)
        fits.append((round(float((w * np.logaddexp(0, np.where(y == 1, -z, z))).sum() / w.sum()), 9), at, quoted, bias, slopes))
    _, _, quoted, bias, slopes = min(fits)
    return ToxicityModel(terms, harmless, bias, slopes, quoted)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` plus a struct ``out`` of score, n_hits and the terms hit.

    Every word of a text is looked up, in one pass and without a shuffle. Null and empty texts have no
    hits and the lowest score; repeated rows score alike; an input column called ``out`` is replaced.
    """
    made: list[Scorer] = []

    def scored(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(model.scorer())
        hits = [made[0].hits(t) if t else [] for t in texts]
        return pd.DataFrame(
            {"score": [made[0].score(h) for h in hits], "n_hits": [len(h) for h in hits], "terms": [sorted({x[0] for x in h}) for h in hits]}
        )

    kind = T.StructType.fromDDL("score double, n_hits int, terms array<string>")
    return docs.withColumn(out, F.pandas_udf(scored, kind)(F.col(text)))
