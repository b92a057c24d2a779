"""What a chat message says about a payment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _upper(c):
    return F.upper(F.coalesce(col(c), F.lit("")))


def is_open_request(kind: Column | str) -> Column:
    k = _upper(kind)
    return F.contains(k, F.lit("REQUEST")) & ~F.contains(k, F.lit("RESPONSE"))


def payment_status(kind: Column | str, content: Column | str) -> Column:
    k = _upper(kind)
    text = F.lower(F.coalesce(col(content), F.lit("")))
    return (
        F.when(k.contains("FAIL") | text.contains("fail"), "failed")
        .when(text.contains("declined") | k.contains("DECLINE"), "declined")
        .when(is_open_request(kind), "requested")
        .when(
            k.contains("TRANSFER") | text.contains("approved") | k.contains("RESPONSE"), "success"
        )
        .otherwise("")
    )


def payment_verb(kind: Column | str, content: Column | str, outgoing: Column) -> Column:
    status = payment_status(kind, content)
    return (
        F.when(is_open_request(kind), "Payment requested")
        .when(status.isin("failed", "declined"), F.concat(F.lit("Payment "), status))
        .when(outgoing, "Sent")
        .otherwise("Received")
    )
