"""One ledger out of two overlapping payment sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .skew import anti_known

#: payment states in which money moved
SETTLED = ("SUCCESS", "COMPLETED")


def _has(kind: Column, word: str) -> Column:
    return F.contains(kind, F.lit(word))


def chat_direction(kind, status, reference, from_subject: Column) -> Column:
    """Direction of a chat payment; an open request has none.

    A request that completed with a reference number was raised by its sender, so money flowed to
    the sender; any other payment flowed away from the sender.
    """
    kind = F.upper(F.coalesce(col(kind), F.lit("")))
    request = _has(kind, "REQUEST") & ~_has(kind, "RESPONSE")
    completed = F.coalesce(
        F.upper(col(status)).isin(*SETTLED) & (F.coalesce(col(reference), F.lit("")) != ""),
        F.lit(False),
    )
    mine = F.coalesce(from_subject, F.lit(False))
    return (
        F.when(request & ~completed, F.lit(None).cast("string"))
        .when(request & mine, "credit")
        .when(request, "debit")
        .when(mine, "debit")
        .otherwise("credit")
    )


def chat_settled(kind, status) -> Column:
    kind = F.upper(F.coalesce(col(kind), F.lit("")))
    moved = F.coalesce(F.upper(col(status)).isin(*SETTLED), F.lit(False))
    return moved & ~_has(kind, "FAIL") & ~_has(kind, "DECLIN")


def ledger_union(
    primary: DataFrame, second: DataFrame, key: str = "source_txn_id", scope: tuple = ("case_id",)
) -> DataFrame:
    """Primary rows plus the rows only the second source has; keyless second rows are kept."""
    extra = anti_known(second, primary.where(F.col(key).isNotNull()), {key: key}, scope)
    return primary.unionByName(extra, allowMissingColumns=True)


def money(c: Column | str) -> Column:
    """Amounts are summed as decimals: exact, and the same whatever the row order."""
    return F.coalesce(col(c).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def money_sum(amount: Column | str, when: Column | None = None) -> Column:
    value = money(amount)
    if when is not None:
        value = F.when(when, value).otherwise(F.lit(0).cast("decimal(18,2)"))
    return F.coalesce(F.sum(value), F.lit(0)).cast("double")
