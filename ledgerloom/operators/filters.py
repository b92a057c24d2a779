"""A filter request compiled to one predicate that Catalyst can push into the scan."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clocks import parse_date_bound

#: columns that can hold an event time, best first; an expiry is not an event
TIME_COLUMNS = ("utc", "timestamp", "last_enqueue", "created", "start_time")
#: columns that describe a record instead of being part of it
NOT_SEARCHED = {"case_id", "domain", "provenance", "raw"}


def time_column(schema: T.StructType) -> Column | None:
    """First filled-in event time of a record, or None when its table can hold none."""
    found = []
    for name in TIME_COLUMNS:
        if name not in schema.fieldNames():
            continue
        kind = schema[name].dataType
        if isinstance(kind, T.StructType) and "utc" in kind.fieldNames():
            found.append(F.col(name)["utc"])
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            found.append(F.col(name))
    return F.coalesce(*found) if found else None


def _leaves(value: Column, kind: T.DataType) -> list[Column]:
    """Boolean-free text of every leaf value; arrays and maps are joined, keys never count."""
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(value[f.name], f.dataType)]
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return [F.to_json(value)]
        return [F.array_join(value.cast("array<string>"), "\n")]
    if isinstance(kind, T.MapType):
        return [F.array_join(F.map_values(value).cast("array<string>"), "\n")]
    return [value.cast("string")]


def text_matches(schema: T.StructType, text: str) -> Column:
    """Case-insensitive substring in any value of the record (not in keys or provenance)."""
    needle = F.lit(text.lower())
    tests = [
        F.coalesce(F.contains(F.lower(leaf), needle), F.lit(False))
        for f in schema.fields
        if f.name not in NOT_SEARCHED
        for leaf in _leaves(F.col(f.name), f.dataType)
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _as_flag(v) -> bool:
    return v if isinstance(v, bool) else str(v).strip().lower() in ("true", "1", "yes")


@dataclass
class FilterSpec:
    """Every given condition must hold. ``skip_inapplicable`` keeps rows of tables that do not have
    the filtered column instead of emptying them."""

    text: str = ""
    date_from: str | None = None
    date_to: str | None = None
    origin: str = "any"
    amount_min: float | None = None
    amount_max: float | None = None
    direction: str | None = None
    source_contains: str = ""
    field_equals: dict = field(default_factory=dict)
    skip_inapplicable: bool = True

    def to_column(self, schema: T.StructType) -> Column:
        parts = [
            self._origin(schema),
            self._date(schema),
            self._amount(schema),
            self._direction(schema),
            self._source(schema),
            *[self._equals(schema, k, v) for k, v in self.field_equals.items()],
            text_matches(schema, self.text) if self.text else None,
        ]
        return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.to_column(df.schema))

    # ---- one condition each; None means "nothing to test" ------------------------------------

    def _origin(self, schema) -> Column | None:
        if self.origin == "any":
            return None
        if "provenance" not in schema.fieldNames():
            return F.lit(False)
        return F.col("provenance")["origin"] == self.origin

    def _source(self, schema) -> Column | None:
        if not self.source_contains:
            return None
        if "provenance" not in schema.fieldNames():
            return F.lit(False)
        path = F.lower(F.col("provenance")["source_file"])
        return F.coalesce(F.contains(path, F.lit(self.source_contains.lower())), F.lit(False))

    def _date(self, schema) -> Column | None:
        if not (self.date_from or self.date_to):
            return None
        when = time_column(schema)
        if when is None:
            return None if self.skip_inapplicable else F.lit(False)
        lower = parse_date_bound(self.date_from, upper=False)
        upper = parse_date_bound(self.date_to, upper=True)
        parts = [when.isNotNull()]
        # zone-less literals in UTC, so the comparison reaches Parquet statistics either way
        if lower:
            parts.append(when >= F.lit(lower.replace(tzinfo=None)).cast("timestamp_ntz"))
        if upper:
            parts.append(when <= F.lit(upper.replace(tzinfo=None)).cast("timestamp_ntz"))
        return reduce(lambda a, b: a & b, parts)

    def _amount(self, schema) -> Column | None:
        if self.amount_min is None and self.amount_max is None:
            return None
        if "amount" not in schema.fieldNames():
            return None if self.skip_inapplicable else F.lit(False)
        amount = F.col("amount").cast("double")
        inside = amount.isNotNull()
        if self.amount_min is not None:
            inside &= amount >= float(self.amount_min)
        if self.amount_max is not None:
            inside &= amount <= float(self.amount_max)
        return (amount.isNull() | inside) if self.skip_inapplicable else inside

    def _direction(self, schema) -> Column | None:
        if not self.direction:
            return None
        if "direction" not in schema.fieldNames():
            return None if self.skip_inapplicable else F.lit(False)
        return F.coalesce(F.col("direction") == self.direction, F.lit(False))

    def _equals(self, schema, name: str, wanted) -> Column:
        if name not in schema.fieldNames():
            return F.lit(False)
        value = F.col(name)
        if isinstance(schema[name].dataType, T.BooleanType):
            return F.coalesce(value, F.lit(False)) == _as_flag(wanted)
        if isinstance(wanted, bool):
            truthy = F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes")
            return F.coalesce(truthy, F.lit(False)) == wanted
        return F.coalesce(value.cast("string") == str(wanted), F.lit(False))

    # ---- presets -----------------------------------------------------------------------------

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, saved: dict | None) -> FilterSpec:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (saved or {}).items() if k in known})


def spec_from_inputs(inputs: dict[str, str]) -> tuple[FilterSpec, list[str]]:
    """A spec from typed text, plus the inputs that could not be read (never dropped silently)."""
    spec, ignored = FilterSpec(), []
    for name in ("text", "origin", "direction", "source_contains"):
        if inputs.get(name):
            setattr(spec, name, inputs[name].strip())
    for name in ("amount_min", "amount_max"):
        typed = (inputs.get(name) or "").strip()
        if typed:
            try:
                setattr(spec, name, float(typed))
            except ValueError:
                ignored.append(f"{name}: {typed!r} is not a number")
    for name, upper in (("date_from", False), ("date_to", True)):
        typed = (inputs.get(name) or "").strip()
        if typed and parse_date_bound(typed, upper=upper) is None:
            ignored.append(f"{name}: {typed!r} is not a date")
        elif typed:
            setattr(spec, name, typed)
    return spec, ignored
