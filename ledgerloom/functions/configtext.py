"""Readable meaning of opaque configuration keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, literal_map, to_double

# Abbreviations spelled out in key names.
ABBREVIATIONS = {
    "kyc": "KYC",
    "otp": "OTP",
    "upi": "UPI",
    "vpa": "UPI-ID",
    "ppb": "Paytm Payments Bank",
    "pg": "payment gateway",
    "mte": "money transfer",
    "pps": "payments",
    "p2p": "peer-to-peer",
    "coft": "card-on-file tokenisation",
    "aotp": "auto-OTP",
    "vkyc": "video KYC",
    "gv": "gift voucher",
    "cc": "credit card",
    "emi": "EMI",
    "ios": "iOS",
    "android": "Android",
    "url": "URL",
    "sdk": "SDK",
    "api": "API",
    "ui": "UI",
    "amnt": "amount",
    "amt": "amount",
    "msg": "message",
    "pwd": "password",
    "min": "minimum",
    "max": "maximum",
    "txn": "transaction",
    "qr": "QR",
    "h5": "web (H5)",
    "tnc": "terms & conditions",
    "ttl": "cache lifetime",
}
# Keys with a known meaning.
KNOWN_KEYS = {
    "AID": "Application install ID (unique to this app installation)",
    "AcceptPayment_isForceUpdateAvailable": "Whether a forced app update is required to accept payments",
    "AddMoneyRefundOption": "Allowed refund destinations for the Add-Money flow",
    "AadhaarOtpFetchConsentURL": "Server URL shown for Aadhaar-OTP consent during KYC",
    "AAMThresholdAmntLowerLimit_iOS": "Add-Money lower amount threshold (iOS)",
    "GoldP2PMaxAmount": "Maximum amount allowed for a Gold peer-to-peer transfer",
    "MaxInstrumentCacheLimitAndroid": "Max number of payment instruments cached locally (Android)",
    "AutoReadOtpEnable": "Whether the app auto-reads incoming OTP SMS",
    "hawkeyeEngineRule": "Rules controlling which telemetry events the app logs/uploads",
    "walletLandingGenericURL_android": "Remote URL for the wallet landing screen layout (Android)",
    "vkycinternalH5Url": "Video-KYC web flow URL",
    "kyc_selfie_upload_url": "Server endpoint for KYC selfie/document upload",
}
# Words in a key that make a number a limit.
LIMIT_WORDS = (
    "threshold",
    "limit",
    "max",
    "min",
    "amount",
    "count",
    "timeout",
    "ttl",
    "interval",
    "size",
    "duration",
)


def config_kind(key: Column | str, value: Column | str) -> Column:
    v = F.trim(F.coalesce(col(value).cast("string"), F.lit("")))
    k = F.lower(F.coalesce(col(key), F.lit("")))
    number = to_double(v).isNotNull()
    return (
        F.when(v.startswith("http://") | v.startswith("https://"), "API endpoint / URL")
        .when(F.lower(v).isin("true", "false"), "Feature flag (on/off)")
        .when(k.rlike("rollout|percentage"), "Experiment / rollout %")
        .when(v.startswith("{") | v.startswith("["), "Structured config (JSON)")
        .when(number & k.rlike("|".join(LIMIT_WORDS)), "Threshold / limit")
        .when(number, "Numeric setting")
        .otherwise("Setting / value")
    )


def humanise_key(key: Column | str) -> Column:
    k = F.regexp_replace(F.coalesce(col(key), F.lit("")), "(?i)_(ios|android)$", "")
    k = F.replace(k, F.lit("_"), F.lit(" "))
    k = F.regexp_replace(k, "([a-z])(?=[A-Z])", "$1 ")
    k = F.regexp_replace(k, "([A-Za-z])(?=[0-9])", "$1 ")
    words = F.filter(F.split(k, r"\s+"), lambda w: w != "")
    spelled = literal_map(ABBREVIATIONS)
    return F.array_join(
        F.transform(words, lambda w: F.coalesce(F.element_at(spelled, F.lower(w)), w)), " "
    )


def config_meaning(key: Column | str) -> Column:
    """Known meaning, else the key in words behind a sign that marks it as derived."""
    known = F.element_at(literal_map(KNOWN_KEYS), col(key))
    return F.coalesce(known, F.concat(F.lit("≈ "), humanise_key(key)))
