"""Payment handles, party names and identifier shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, literal_map, present

# Handle suffix -> provider.
HANDLE_PROVIDERS = {
    "icici": "ICICI Bank",
    "ibl": "ICICI Bank",
    "okicici": "ICICI (Google Pay)",
    "ptybl": "Paytm Payments Bank",
    "paytm": "Paytm",
    "ptaxis": "Axis (Paytm)",
    "axisbank": "Axis Bank",
    "axl": "Axis Bank",
    "okaxis": "Axis (Google Pay)",
    "hdfcbank": "HDFC Bank",
    "okhdfcbank": "HDFC (Google Pay)",
    "payzapp": "HDFC PayZapp",
    "ybl": "Yes Bank (PhonePe)",
    "yesbank": "Yes Bank",
    "yesbankltd": "Yes Bank",
    "ypbiz": "Yes Bank (business)",
    "oksbi": "SBI (Google Pay)",
    "sbi": "SBI",
    "airtel": "Airtel Payments Bank",
    "mairtel": "Airtel",
    "rxairtel": "Airtel",
    "apl": "Amazon Pay",
    "fbpe": "BharatPe (Yes/ICICI)",
    "idfcbank": "IDFC First",
    "famc": "Trans Bank (Fam)",
    "ptsbi": "SBI (Paytm)",
}
# Brand tokens that mark a merchant handle.
MERCHANT_TOKENS = (
    "paytm-",
    "swiggy",
    "zomato",
    "redbus",
    "bharatpe",
    "amzn",
    "rzp",
    "payu",
    "easebuzz",
    "hungerbox",
)
# Company suffix words that do not tell two parties apart.
COMPANY_SUFFIX = (
    r"\b(private limited|pvt\.? ?ltd\.?|pvt\.? limited|limited|ltd\.?|inc\.?|llp"
    r"|technologies|technology|india)\b"
)


def handle_user(c: Column | str) -> Column:
    return present(F.substring_index(col(c), "@", 1))


def handle_suffix(c: Column | str) -> Column:
    v = col(c)
    return F.when(F.contains(v, F.lit("@")), F.lower(F.substr(v, F.instr(v, "@") + 1)))


def handle_provider(c: Column | str) -> Column:
    suffix = F.nullif(handle_suffix(c), F.lit(""))
    return F.coalesce(F.element_at(literal_map(HANDLE_PROVIDERS), suffix), suffix)


def looks_like_merchant(c: Column | str) -> Column:
    user = handle_user(c)
    branded = F.lower(user).rlike("|".join(MERCHANT_TOKENS))
    return F.coalesce(branded | (F.length(user) > 18), F.lit(False))


def party_name_key(c: Column | str) -> Column:
    """Comparison form of a name: no case, no company suffix, only ASCII letters and digits.

    A name that leaves nothing behind (other scripts) has no key, so it never matches another one.
    """
    bare = F.regexp_replace(F.lower(col(c)), COMPANY_SUFFIX, " ")
    return F.nullif(F.regexp_replace(bare, "[^a-z0-9]+", ""), F.lit(""))


# ---- identifier shapes -----------------------------------------------------------------------

RRN = r"^[0-9]{12}$"
MOBILE = r"^[6-9][0-9]{9}$"
HANDLE = r"^[a-zA-Z0-9._-]{2,}@[a-zA-Z]{3,}$"
TXN_ID = r"^(?:PYTM|PTM|AXI|HDF|UPI|ICI|SBI)[A-Za-z0-9]{8,}$"


def last_token_rrn(c: Column | str) -> Column:
    """The trailing comma token when it is a 12-digit reference number."""
    last = F.trim(F.element_at(F.split(col(c), ","), -1))
    return F.when(last.rlike(RRN), last)


def first_token_mobile(c: Column | str) -> Column:
    tokens = F.transform(F.split(col(c), ","), lambda t: F.trim(t))
    return F.get(F.filter(tokens, lambda t: t.rlike(MOBILE)), 0)


def identifier_kind(c: Column | str) -> Column:
    """Exclusive ladder: handle, mobile, reference number, transaction id, short text."""
    v = col(c)
    return (
        F.when(v.rlike(HANDLE) & (F.length(v) < 60), "vpa")
        .when(v.rlike(MOBILE), "phone")
        .when(v.rlike(RRN), "rrn")
        .when(v.rlike(TXN_ID), "txn_id")
        .when(F.length(v).between(2, 80), "text")
    )


def ciphertext_shaped(c: Column | str) -> Column:
    """A long body made of nothing but base64 characters (readable JSON is not)."""
    v = col(c)
    return F.coalesce(
        ~v.rlike(r"^\s*[\[{]") & v.rlike(r"^[A-Za-z0-9+/\s]{64,}={0,2}\s*$"), F.lit(False)
    )
