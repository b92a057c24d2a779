"""Timestamp decoding and date bounds."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, is_integer_text, present

#: Seconds from 1601-01-01 to 1970-01-01, and the last second of year 9999.
WEBKIT_EPOCH_OFFSET_S = 11_644_473_600
LAST_SECOND = 253_402_300_799

TIME_STRUCT = "struct<raw:string,epoch_type:string,utc:timestamp>"


def no_time() -> Column:
    return F.lit(None).cast(TIME_STRUCT)


#: unit -> (smallest number read as it, largest one that still is a year up to 9999)
EPOCH_UNITS = {
    "webkit_us": (10**15, (LAST_SECOND + WEBKIT_EPOCH_OFFSET_S) * 10**6 + 999_999),
    "unix_ms": (10**11, LAST_SECOND * 1000 + 999),
    "unix_s": (10**9, LAST_SECOND),
}


def _instant(unit: str, n: Column) -> Column:
    if unit == "webkit_us":
        return F.timestamp_micros(n - WEBKIT_EPOCH_OFFSET_S * 1_000_000)
    return F.timestamp_millis(n) if unit == "unix_ms" else F.timestamp_seconds(n)


def decode_epoch(c: Column | str, hint: str | None = None) -> Column:
    """``struct(raw, epoch_type, utc)`` of a number whose unit is told by its size (or ``hint``).

    ``c`` is mentioned many times below: give a computed value a column of its own first.
    """
    raw = col(c).cast("string")
    n = F.trim(raw).try_cast("bigint")
    units = {hint: (1, EPOCH_UNITS[hint][1])} if hint else EPOCH_UNITS
    label = (
        F.when(raw.isNull() | ~is_integer_text(raw), F.lit(None).cast("string"))
        .when(n <= 0, "invalid")
        .when(n.isNull(), F.when(F.trim(raw).startswith("-"), "invalid").otherwise("out_of_range"))
    )
    utc = None
    for unit, (least, most) in units.items():
        label = label.when(n.between(least, most), unit)
        instant = _instant(unit, n)
        utc = (F if utc is None else utc).when(n.between(least, most), instant)
        label = label.when(n >= least, "out_of_range")
    return F.struct(raw.alias("raw"), label.otherwise("unknown").alias("epoch_type"), utc.alias("utc"))


def first_filled(*cs: Column | str) -> Column:
    """The first time column that is filled in (0 is not)."""
    return F.coalesce(*[F.nullif(present(c), F.lit("0")) for c in cs])


def http_date(c: Column | str) -> Column:
    """RFC 2822 date (weekday optional, named or numeric zone); anything else is null."""
    text = F.regexp_replace(F.trim(col(c)), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss xx")),
    )


def shift_hours(ts: Column | str, hours: float) -> Column:
    """Wall-clock reading ``hours`` east of UTC, still labelled as the stored zone."""
    return F.timestamp_micros(F.unix_micros(col(ts)) + F.lit(int(hours * 3_600_000_000)))


def show_time(ts: Column | str) -> Column:
    return F.date_format(col(ts), "dd MMM yyyy, HH:mm:ss")


def iso_time(ts: Column | str) -> Column:
    """ISO text with the fraction only when there is one."""
    c = col(ts)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.when(F.unix_micros(c) % 1_000_000 == 0, whole).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )


#: Accepted spellings of a typed date besides ISO.
DATE_SPELLINGS = ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d")


def parse_date_bound(text: str | None, *, upper: bool) -> datetime | None:
    """A typed date as an aware UTC bound; a bare upper date reaches to the end of its day."""
    typed = (text or "").strip()
    if not typed:
        return None
    bare = True
    moment = None
    try:
        moment = datetime.fromisoformat(typed)
        bare = len(typed) <= 10
    except ValueError:
        for spelling in DATE_SPELLINGS:
            try:
                moment = datetime.strptime(typed, spelling)
            except ValueError:
                continue
            break
    if moment is None:
        return None
    if bare and upper:
        midnight = moment.replace(hour=0, minute=0, second=0, microsecond=0)
        moment = midnight + timedelta(days=1, microseconds=-1)
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)
