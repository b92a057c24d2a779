"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    per_class: int,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, dict[int, float]]:
    """((key, text, label) of at most ``per_class`` documents of either label, weight of each label).

    The ids are drawn from the label table alone, by hash order, among those whose crc32 modulo
    ``modulus`` is not ``held_out``; the few ids drawn are broadcast, so no text is shuffled. A
    label's weight is its number of labelled documents over its number of drawn ones. Ids labelled
    twice count once (the larger label); null ids and null labels are not used.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_of_id(key) % modulus != held_out))
    known = usable.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    parts = []
    for value in (0, 1):
        drawn = known.where(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(per_class)
        parts += [(r[key], value) for r in drawn.collect()]
    drawn = docs.sparkSession.createDataFrame(parts, f"{key} {docs.schema[key].dataType.simpleString()}, label int")
    rows = docs.select(key, text).join(F.broadcast(drawn), key)
    n = {v: sum(x[1] == v for x in parts) for v in (0, 1)}
    return rows, {v: totals.get(v, 0) / n[v] if n[v] else 0.0 for v in (0, 1)}
