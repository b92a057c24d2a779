"""JSON documents embedded in binary or mixed content.

The JSON is followed by other bytes, which ``parse_json`` rejects, so finding where a document ends
needs a decoder that stops by itself. Only that step runs in Python, batch by batch.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame

_DECODER = json.JSONDecoder()
_URL = re.compile(rb"https?://[\x21-\x7e]{6,}")

FOUND = "pos int, body string, url string"


def first_document(content: bytes) -> tuple[str, str | None] | None:
    """The JSON document a response starts with, and the first URL after it."""
    text = content.decode("utf-8", "ignore")
    start = text.find("{")
    if start < 0:
        return None
    if "<html" in text[:start].lower() or "function(" in text[: start + 60]:
        return None
    try:
        document, length = _DECODER.raw_decode(text[start:])
    except ValueError:
        return None
    url = _URL.search(content, start + length)
    return json.dumps(document, ensure_ascii=False), url.group(0).decode("ascii") if url else None


def all_documents(content: bytes) -> list[str]:
    """Every JSON object in the content, outermost ones only."""
    text, found, at = content.decode("utf-8", "ignore"), [], 0
    while (at := text.find("{", at)) >= 0:
        try:
            document, length = _DECODER.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if document:
            found.append(json.dumps(document, ensure_ascii=False))
        at = max(length, at + 1)
    return found


def document_after(content: bytes, marker: str) -> str | None:
    """The JSON object that follows a marker (or the first one without it)."""
    text = content.decode("utf-8", "ignore")
    start = text.find("{", max(text.find(marker), 0))
    if start < 0:
        return None
    try:
        document, _ = _DECODER.raw_decode(text, start)
    except ValueError:
        return None
    return json.dumps(document, ensure_ascii=False) if isinstance(document, dict) else None


def _scan(files: DataFrame, keys: list[str], pick) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + FOUND

    def run(batches):
        for pdf in batches:
            rows = []
            for *ids, content in pdf.itertuples(index=False):
                rows += [(*ids, i, *hit) for i, hit in enumerate(pick(bytes(content)))]
            yield pd.DataFrame(rows, columns=[*keys, "pos", "body", "url"])

    return files.select(*keys, "content").mapInPandas(run, schema)


def json_responses(files: DataFrame, keys: list[str]) -> DataFrame:
    """Cached responses whose body is JSON: (keys, body, url)."""

    def pick(content):
        hit = first_document(content)
        return [hit] if hit else []

    return _scan(files, keys, pick).drop("pos")


def json_objects(files: DataFrame, keys: list[str]) -> DataFrame:
    """All embedded JSON objects: (keys, pos, body)."""
    return _scan(files, keys, lambda c: [(d, None) for d in all_documents(c)]).drop("url")


def json_after(files: DataFrame, keys: list[str], marker: str) -> DataFrame:
    def pick(content):
        hit = document_after(content, marker)
        return [(hit, None)] if hit else []

    return _scan(files, keys, pick).drop("url", "pos")
