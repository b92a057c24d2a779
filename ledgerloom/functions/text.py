"""Small text and number helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BULLET = "•"
#: Unicode word characters (letters, numbers, underscore), usable inside a character class
WORD = r"\p{L}\p{N}_"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """The text of ``c``, with the empty string read as missing."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def present_number(c: Column | str) -> Column:
    """Like :func:`present` for numeric source columns, where 0 also means 'not filled in'."""
    return F.nullif(present(c), F.lit("0"))


def first_present(*cs: Column | str) -> Column:
    return F.coalesce(*[present(c) for c in cs])


_FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INT = r"^\s*[+-]?[0-9]+\s*$"


def to_double(c: Column | str) -> Column:
    """Tolerant number parse: anything that is not a plain number is null (``12d`` included)."""
    s = col(c).cast("string")
    return F.when(s.rlike(_FLOAT), F.trim(s).try_cast("double"))


def to_bigint(c: Column | str) -> Column:
    s = col(c).cast("string")
    return F.when(s.rlike(_INT), F.trim(s).try_cast("bigint"))


def is_integer_text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string").rlike(_INT), F.lit(False))


def truncate(c: Column | str, n: int) -> Column:
    return F.left(col(c), F.lit(n))


def short_class(c: Column | str) -> Column:
    return F.substring_index(col(c), ".", -1)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it.

    Column expressions are inlined where they are used, so a chain of steps that each mention
    their input four times would otherwise grow as 4^steps.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rejoin(gaps: Column, pieces: Column) -> Column:
    tail = F.concat(pieces, F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, tail, lambda a, b: F.concat(a, b)), "")


def rewrite_matches(
    s: Column, pattern: str, mask: Callable[[Column], Column], needs: Callable[[Column], Column] | None = None
) -> Column:
    """Replace every match of ``pattern`` by ``mask(match)``.

    ``regexp_replace`` only knows fixed replacements; the masks here depend on the match. The text
    is cut at the matches and joined again with the masked pieces, all inside one expression, and
    texts without any match skip that work. ``needs`` is a cheap test that every text with a match
    passes; the pattern is not tried on the others.
    """

    def body(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        rewritten = _rejoin(F.split(x, pattern, -1), F.transform(found, mask))
        matched = x.rlike(pattern)
        return F.when(needs(x) & matched if needs else matched, rewritten).otherwise(x)

    return bind(s, body)


def rewrite_groups(
    s: Column, pattern: str, mask: Callable[[Column, Column], Column], needs: Callable[[Column], Column] | None = None
) -> Column:
    """As :func:`rewrite_matches` with the first two capture groups handed to ``mask``."""

    def body(x: Column) -> Column:
        one = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
        two = F.regexp_extract_all(x, F.lit(pattern), F.lit(2))
        rewritten = _rejoin(F.split(x, pattern, -1), F.zip_with(one, two, mask))
        matched = x.rlike(pattern)
        return F.when(needs(x) & matched if needs else matched, rewritten).otherwise(x)

    return bind(s, body)


def bullets(n: Column) -> Column:
    return F.repeat(F.lit(BULLET), F.greatest(n, F.lit(1)))


def escape_markup(c: Column | str) -> Column:
    """HTML / XML text escaping, applied by text sinks only."""
    out = F.coalesce(col(c).cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def hex_text(c: Column | str) -> Column:
    return F.lower(F.hex(col(c)))


def canonical_row(columns: list[str]) -> Column:
    """One row as JSON with sorted keys and explicit nulls, for digests and stable exports."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


# ---- JSON held in text columns -------------------------------------------------------------


def json_text(c: Column | str, path: str) -> Column:
    """One JSON field as text; malformed JSON and missing fields give null."""
    return F.get_json_object(col(c), path)


def nested_json_text(c: Column | str, outer: str, inner: str) -> Column:
    """A field of a JSON document that is itself stored as text inside another document."""
    return F.get_json_object(F.get_json_object(col(c), outer), inner)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds an expensive column that later filters and projections share.

    Filters on a plain computed column are pushed below it with the computation copied into them;
    they are not pushed below a generator, which here makes exactly one row of each.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def with_document(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the JSON document of a text column, parsed once; null unless the text is exactly
    one document.

    The path functions over text stop reading once they have their answer, so they accept garbage
    behind a document; as the only element of an array it has to be whole.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]")))
    alone = F.try_variant_get("_parsed", "$[1]", "variant").isNull()
    once = computed_once(df, "_parsed", parsed)
    return once.withColumn(out, F.when(alone, F.col("_parsed"))).drop("_parsed")


def in_document(c: Column | str, path: str, kind: str = "string") -> Column:
    """A field of a document made by :func:`with_document`; ``path`` starts below the root."""
    return F.try_variant_get(col(c), "$[0]" + path, kind)
