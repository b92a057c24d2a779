"""Sequence packing by harmonic classes."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


# ---- token ids ---------------------------------------------------------------------------------


class ByteBpe:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file, several times faster.

    The split into words is the one of that file's byte-level pre-tokenizer. Where a text has no
    apostrophe and no two white-space characters in a row, simpler patterns cut at the same places,
    and those run without look-ahead. Texts with characters beyond Latin, General Punctuation and
    currency signs, or with the string of a special token, go to the library itself, as their
    classes may depend on the Unicode version.
    """

    _WORDS = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
    _SHORT = r"'(?:[sdmt]|ll|ve|re)|"
    _ASCII = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
    _WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _FAR = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        signs = self._signs()
        ranks = {bytes(signs[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        places = [vocab[a + b] for a, b in merges]
        # merge order must equal id order; otherwise ranks would not say the same as the merges
        self.fast = spec["pre_tokenizer"].get("type") == "ByteLevel" and places == sorted(places)
        if self.fast:
            whole = self._SHORT + self._WORDS + r"|\s+(?!\S)|\s+"
            make = lambda p: tiktoken.Encoding("bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            self.plain, self.quoted = make(self._WORDS + r"|\s+"), make(self._SHORT + self._WORDS + r"|\s+")
            self.whole = make(whole)

    @staticmethod
    def _signs() -> dict[str, int]:
        """The printable sign that stands for each byte in the file."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def ids(self, text: str) -> np.ndarray:
        ascii_only = text.isascii()
        if not self.fast or any(x in text for x in self.special) or (not ascii_only and self._FAR.search(text)):
            found = self.library.encode(text, add_special_tokens=False).ids
        elif any(x in text for x in self._ASCII) or (not ascii_only and self._WIDE.search(text)):
            found = self.whole(text)
        else:
            found = (self.quoted if "'" in text else self.plain)(text)
        return np.array(found, dtype="<u4")


_TOKENIZERS: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One tokenizer per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteBpe(path)
    return _TOKENIZERS[path]


# ---- harmonic classes --------------------------------------------------------------------------


def cut_lengths(total: int, capacity: int, waste: float) -> list[int]:
    """Piece lengths of a document of ``total`` tokens.

    Full sequences first. The rest stays whole if its class leaves at most ``waste`` of a slot empty;
    otherwise it is cut at the next smaller reciprocal of the capacity, which fills its slot, and
    what is left is treated alike.
    """
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        slots = capacity // rest
        slot = capacity // slots
        if slot - rest <= waste * slot:
            out.append(rest)
            break
        out.append(capacity // (slots + 1))
        rest -= out[-1]
    return out


class Bins:
    """The open bins of one worker: one per class k, closed when it holds k pieces."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next = capacity, worker << 33
        self.open: dict[int, list[int]] = {}

    def add(self, length: int) -> tuple[int, int, int]:
        """(class, bin number, offset); bins are numbered anew once the open ones are merged."""
        k = self.capacity // length
        held = self.open.get(k)
        if held is None:
            held = self.open[k] = [self.next, 0, 0]
            self.next += 1
        place = (k, held[0], held[1])
        held[1] += length
        held[2] += 1
        if held[2] == k:
            del self.open[k]
        return place

def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, longest first; only for the few pieces of unfilled bins."""
    fill: list[int] = []
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, used in enumerate(fill):
            if used + lengths[i] <= capacity:
                break
        else:
            b, used = len(fill), 0
            fill.append(0)
        out[i] = (b, used)
        fill[b] = used + lengths[i]
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    waste: float = 1 / 32,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A piece of length n belongs to class k = capacity // n, and a sequence of class k takes exactly k
    pieces. Every worker fills the sequences of its own split, so nothing is shuffled and a lost
    executor repeats only its splits. Sequences still open at the end of a split, at most one per
    class, are emptied and their pieces packed again by first fit, so a split leaves about one
    sequence unfilled. Documents are cut only where a class would leave more than ``waste`` of its
    slot empty. Sequence numbers are the split's number times 2^33 plus a running number.

    Null and empty texts are one piece that holds ``end_id``; a null key and repeated rows are packed
    like any row; other columns of ``docs`` are not read.
    """
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, {PIECES}" + (", ids array<bigint>" if with_ids else "")
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(tokenizer_path)
        bins = Bins(capacity, TaskContext.get().partitionId())
        held: dict[int, list[tuple]] = {}  # rows of open bins
        for batch in batches:
            done: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokens.ids(body.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at = 0
                for length in cut_lengths(len(ids), capacity, waste):
                    part = ids[at : at + length]
                    k, number, offset = bins.add(length)
                    row = (doc, at, length, zlib.crc32(part.tobytes()), len(ids), number, offset)
                    held.setdefault(number, []).append((*row, part.tolist()) if with_ids else row)
                    if k not in bins.open:
                        done += held.pop(number)
                    at += length
            yield framed(done)
        rest = [row for number in sorted(held) for row in held[number]]
        places = first_fit([row[2] for row in rest], capacity)
        yield framed([(*row[:5], bins.next + b, o, *row[7:]) for row, (b, o) in zip(rest, places, strict=True)])

    def framed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(shape)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, shape, strict=True)], schema=shape
        )

    return docs.select(key, text).mapInArrow(run, schema)
