"""Which real names occur in which text, without shipping the name list to every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import mask_text
from ..session import cut_lineage

#: window lengths a name can be found by: short names by 3 characters, longer ones by 6
GRAM_SIZES = (3, 6)

#: most names that are shipped to every executor
BROADCAST_NAMES = 500_000
#: most characters of found names that are shipped to every executor
BROADCAST_CHARS = 64_000_000

#: most different first characters of anchors that a text is searched for
FIRSTS = 1_000

#: (domain, field) pairs that hold real names
NAME_FIELDS = (
    ("person", "name"),
    ("person", "verified_name"),
    ("entity", "names"),
    ("message", "sender_name"),
    ("message", "chat_with"),
    ("transaction", "counterparty_name"),
)


def known_names(domains: dict[str, DataFrame]) -> DataFrame:
    """Distinct names (longer than two characters) of a case: (case_id, name)."""
    parts = []
    for domain, field in NAME_FIELDS:
        if domain in domains:
            value = F.explode(field) if field == "names" else F.col(field)
            parts.append(domains[domain].select("case_id", value.alias("name")))
    return reduce(DataFrame.unionByName, parts).where(F.length("name") > 2).distinct()


def _windows(text, size: int, firsts: str | None = None):
    """All character windows of one length, or those that start with one of ``firsts``. A look-ahead
    walks the text once, where repeated substrings would start from its beginning every time."""
    first = "." if firsts is None else "[%s]" % "".join(r"\x{%x}" % ord(c) for c in firsts)
    return F.regexp_extract_all(text, F.lit("(?s)(?=(%s.{%d}))" % (first, size - 1)), F.lit(1))


def name_anchors(names: DataFrame, scope: list[str]) -> DataFrame:
    """One gram per name to find it by: one that few other names contain and that starts with a
    character that is rare in names, so that few places of a text have to be looked up."""
    short, long = (_windows(F.col("name"), size) for size in GRAM_SIZES)
    own = F.when(F.length("name") >= GRAM_SIZES[1], long).otherwise(short)
    grams = names.select(*scope, "name", F.explode(F.array_distinct(own)).alias("gram"))
    spread = grams.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("n"))
    # a table of characters, whatever the number of names
    starts = grams.groupBy(F.left("gram", F.lit(1)).alias("first")).agg(F.count(F.lit(1)).alias("m"))
    found = grams.join(spread, [*scope, "gram"]).withColumn("first", F.left("gram", F.lit(1)))
    cost = F.col("n").cast("double") * F.col("n") * F.col("m")
    return (
        found.join(F.broadcast(starts), "first")
        .groupBy(*scope, "name")
        .agg(F.min_by("gram", F.struct(cost, "gram")).alias("gram"))
    )


def names_in_texts(
    texts: DataFrame, key: str, text: str, names: DataFrame, scope: list[str] | None = None
) -> DataFrame:
    """(key, known_names) for texts that may contain known names, longest first.

    Every window of a text that starts like an anchor is looked up among the name anchors: nothing is
    missed and no text meets every name. A candidate that is not in the text after all is harmless, as
    masking replaces exact occurrences only.
    """
    scope = scope or []
    anchors = cut_lineage(name_anchors(names, scope))
    # their number and their first characters decide how they are met
    n_anchors = anchors.count()
    starts = anchors.select(F.length("gram").alias("size"), F.left("gram", F.lit(1)).alias("first")).distinct()
    firsts: dict[int, list[str]] = {}
    for r in (known := starts.limit(FIRSTS + 1).collect()):
        firsts.setdefault(r["size"], []).append(r["first"])
    if len(known) > FIRSTS:
        found = [_windows(F.col(text), s) for s in GRAM_SIZES]
    else:
        found = [_windows(F.col(text), s, "".join(sorted(c))) for s, c in sorted(firsts.items())]
    found = found or [_windows(F.col(text), GRAM_SIZES[0])]
    windows = texts.select(*scope, key, F.explode(F.concat(*found)).alias("gram"))
    # a checked, bounded anchor table is broadcast, so windows without a name are dropped in place;
    # a larger one is met by a shuffle on the window
    side = F.broadcast(anchors) if n_anchors <= BROADCAST_NAMES else anchors
    candidates = windows.join(side, [*scope, "gram"]).select(key, "name").distinct()
    longest_first = F.transform(
        F.array_sort(
            F.collect_list(F.struct((-F.length("name")).alias("len"), F.col("name").alias("name")))
        ),
        lambda s: s["name"],
    )
    return candidates.groupBy(key).agg(longest_first.alias("known_names"))


def mask_texts(texts: DataFrame, key: str, text: str, names: DataFrame, scope=None) -> DataFrame:
    """Masked texts. The candidate names are a small written table; while it stays small it is
    broadcast, so the texts themselves are never shuffled."""
    hits = cut_lineage(names_in_texts(texts, key, text, names, scope))
    n_chars = hits.agg(F.sum(F.length(F.array_join("known_names", " ")) + 32)).first()[0] or 0
    side = F.broadcast(hits) if n_chars <= BROADCAST_CHARS else hits
    none = F.array().cast("array<string>")
    return (
        texts.join(side, key, "left")
        .withColumn(text, mask_text(F.col(text), F.coalesce("known_names", none)))
        .drop("known_names")
    )
