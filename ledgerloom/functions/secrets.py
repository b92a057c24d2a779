"""Length-only redaction of credentials, by key name and by value shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, rewrite_groups, rewrite_matches

# Keys that always hold a credential, and the words that mark one.
SECRET_KEYS = (
    "sso_token=",
    "pb_auth_token",
    "bank_user_token",
    "key_bank_token",
    "bank_refresh_token",
    "log_id_token",
    "afUninstallToken",
)
SECRET_KEY_WORDS = (
    r"(?i)(token|secret|session[_-]?key|passw|auth|credential|private[_-]?key|api[_-]?key)"
)

_JWT = r"eyJ[A-Za-z0-9_\-]{16,}(?:\.[A-Za-z0-9_\-]+)*"
# begins where a run begins and never gives back, so long runs are read once
_PUSH_TOKEN = r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{16,}+:APA91[A-Za-z0-9_\-]{16,}"
_BEARER = r"((?i:bearer)\s+)([A-Za-z0-9._~+/=\-]{8,})"
_ASSIGNED = (
    r"((?i:token|secret|passw(?:or)?d|api[_\-]?key)[\"']?\s*[:=]\s*[\"']?)"
    r"([^\s\"'&,;<>{}\[\]]{8,})"
)


def redaction(value: Column) -> Column:
    return F.concat(F.lit("<redacted:"), F.length(value).cast("string"), F.lit(" chars>"))


def redact_text(c: Column | str) -> Column:
    """Free text with every token-shaped span replaced by its length."""
    out = col(c)
    out = rewrite_matches(out, _JWT, redaction)
    out = rewrite_matches(out, _PUSH_TOKEN, redaction)
    out = rewrite_groups(out, _BEARER, lambda lead, tok: F.concat(lead, redaction(tok)))
    return rewrite_groups(out, _ASSIGNED, lambda lead, tok: F.concat(lead, redaction(tok)))


def is_secret_key(c: Column | str) -> Column:
    k = col(c)
    return F.coalesce(k.isin(*SECRET_KEYS) | k.rlike(SECRET_KEY_WORDS), F.lit(False))


def redact_value(key: Column | str, value: Column | str) -> Column:
    v = col(value).cast("string")
    return F.when(is_secret_key(key) & (v != ""), redaction(v)).otherwise(redact_text(v))


def redact_setting(key: Column | str, value: Column | str) -> Column:
    """Settings are redacted whole as soon as their key or any part of the value is secret."""
    v = col(value).cast("string")
    secret = is_secret_key(key) | (redact_text(v) != v)
    return F.when((v != "") & secret, redaction(v)).otherwise(v)


# Shapes that should not reach any output.
TOKEN_SHAPES = (
    r"(eyJ[A-Za-z0-9_\-]{20,}"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    r"|[A-Za-z0-9+/]{60,}={0,2})"
)


def token_shaped(c: Column | str) -> Column:
    v = col(c)
    return F.coalesce(v.rlike(TOKEN_SHAPES) & ~v.startswith("<redacted"), F.lit(False))
