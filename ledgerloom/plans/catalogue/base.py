"""Registered queries: a Spark plan and the SQL that says the same thing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...session import tune


class Tables:
    """The Parquet tables of one folder, opened lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._open: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(tune(spark), folder))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return add


def number_top(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Ranks of a top-k result; the input is already limited, so one task sees k rows."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


# ---- SQL text fragments ------------------------------------------------------------------------


def sql_money(amount: str, when: str | None = None) -> str:
    value = f"CAST({amount} AS DECIMAL(18,2))"
    if when:
        value = f"CASE WHEN {when} THEN {value} ELSE 0 END"
    return f"CAST(coalesce(sum(coalesce({value}, 0)), 0) AS DOUBLE)"


def sql_words(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN length(w) <= 1 "
        f"THEN w ELSE left(w, 1) || repeat('•', length(w) - 1) END), ' ')"
    )


def sql_rejoin(s: str, pattern: str, mask: str) -> str:
    """Cut at the matches, mask each match ``m`` and join again."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({s}, '{pattern}'), "
        f"list_concat(list_transform(regexp_extract_all({s}, '{pattern}'), lambda m: {mask}), [''])), "
        f"lambda z: z[1] || z[2]), '')"
    )
