"""Code tables: payment indicators, statuses, categories, job states, bank prefixes, error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .error_texts import ERROR_TEXTS
from .text import col, literal_map, to_bigint

# Integer codes of the source stores and the labels shown for them.
TXN_INDICATOR = {1: "credit", 2: "debit"}
TXN_STATUS = {1: "pending", 2: "success", 3: "failed", 4: "refunded"}
TXN_CATEGORY = {1: "food_and_beverages", 2: "money_in", 9: "cashback"}
JOB_STATE = {
    0: "ENQUEUED",
    1: "RUNNING",
    2: "SUCCEEDED",
    3: "FAILED",
    4: "BLOCKED",
    5: "CANCELLED",
}

# First four letters of a branch code -> bank.
BANKS = {
    "HDFC": "HDFC Bank",
    "ICIC": "ICICI Bank",
    "SBIN": "State Bank of India",
    "BARB": "Bank of Baroda",
    "UTIB": "Axis Bank",
    "PUNB": "Punjab National Bank",
    "CNRB": "Canara Bank",
    "UBIN": "Union Bank of India",
    "KKBK": "Kotak Mahindra Bank",
    "YESB": "Yes Bank",
    "IDFB": "IDFC First Bank",
    "INDB": "IndusInd Bank",
    "FDRL": "Federal Bank",
    "IBKL": "IDBI Bank",
    "RATN": "RBL Bank",
    "PYTM": "Paytm Payments Bank",
    "AIRP": "Airtel Payments Bank",
    "IOBA": "Indian Overseas Bank",
    "IDIB": "Indian Bank",
    "MAHB": "Bank of Maharashtra",
    "CBIN": "Central Bank of India",
    "BKID": "Bank of India",
    "UCBA": "UCO Bank",
    "PSIB": "Punjab & Sind Bank",
    "JAKA": "Jammu & Kashmir Bank",
    "KARB": "Karnataka Bank",
    "SIBL": "South Indian Bank",
    "CIUB": "City Union Bank",
    "DLXB": "Dhanlaxmi Bank",
    "KVBL": "Karur Vysya Bank",
    "TMBL": "Tamilnad Mercantile Bank",
    "ESFB": "Equitas Small Finance Bank",
    "AUBL": "AU Small Finance Bank",
    "UJVN": "Ujjivan Small Finance Bank",
    "DBSS": "DBS Bank India",
    "SCBL": "Standard Chartered Bank",
    "CITI": "Citibank",
    "HSBC": "HSBC India",
    "BNPA": "BNP Paribas",
    "DEUT": "Deutsche Bank",
    "ANDB": "Andhra Bank",
    "CORP": "Corporation Bank",
    "ALLA": "Allahabad Bank",
    "SYNB": "Syndicate Bank",
    "ORBC": "Oriental Bank of Commerce",
    "VIJB": "Vijaya Bank",
    "DENA": "Dena Bank",
    "TKM": "Tamil Nadu Mercantile Bank",
    "FINO": "Fino Payments Bank",
    "NSPB": "NSDL Payments Bank",
    "JIOP": "Jio Payments Bank",
}


def label(table: dict[int, str], c: Column | str) -> Column:
    """Label of an integer code; unknown or non-integer codes stay visible as ``code:<value>``."""
    raw = col(c).cast("string")
    known = F.element_at(literal_map(table), to_bigint(raw).try_cast("int"))
    return F.coalesce(known, F.concat(F.lit("code:"), raw))


def txn_direction(c: Column | str) -> Column:
    return label(TXN_INDICATOR, c)


def txn_status(c: Column | str) -> Column:
    return label(TXN_STATUS, c)


def txn_category(c: Column | str) -> Column:
    return label(TXN_CATEGORY, c)


def job_state(c: Column | str) -> Column:
    return label(JOB_STATE, c)


def error_message(c: Column | str) -> Column:
    """Text of an error code, null when the code is empty or unknown."""
    return F.element_at(literal_map(ERROR_TEXTS), F.nullif(col(c).cast("string"), F.lit("")))


BRANCH_CODE = r"[A-Z]{4}0[A-Z0-9]{6}"


def branch_code(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.upper(col(c)), BRANCH_CODE, 0), F.lit(""))


def bank_name(c: Column | str) -> Column:
    return F.element_at(literal_map(BANKS), F.left(branch_code(c), F.lit(4)))


def bank_branch(c: Column | str) -> Column:
    return F.right(branch_code(c), F.lit(6))
