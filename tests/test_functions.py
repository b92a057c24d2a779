"""Scalar functions against hand-written values."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import chattext, clocks, codes, configtext, masks, parties, secrets, text

JWT = (
    "eyJhbGciOiJFUzI1NiIsInR5cCI6IkpXVCJ9."
    "eyJhcHBJZCI6IjE6NDk2NDUxMjM0NTY3OmFuZHJvaWQ6YWJjZGVm."
    "MEUCIQDabcdefghijklmnopqrstuvwxyz0123456789"
)


@pytest.fixture
def value(spark):
    def run(fn, *inputs):
        cols = [f"c{i}" for i in range(len(inputs))]
        schema = ", ".join(f"{c} string" for c in cols)
        df = spark.createDataFrame([tuple(inputs)], schema)
        return df.select(fn(*cols).alias("v")).first().v

    return run


@pytest.mark.parametrize(
    "raw, kind, instant",
    [
        ("1723742756754", "unix_ms", datetime(2024, 8, 15, 17, 25, 56, 754000)),
        ("1723742756", "unix_s", datetime(2024, 8, 15, 17, 25, 56)),
        (str((1_767_225_600 + 11_644_473_600) * 10**6), "webkit_us", datetime(2026, 1, 1)),
        ("0", "invalid", None),
        ("-4", "invalid", None),
        ("12345", "unknown", None),
        ("999999999999999", "out_of_range", None),
        ("99999999999999999999999", "out_of_range", None),
        ("-99999999999999999999999", "invalid", None),
        ("", None, None),
        (None, None, None),
        ("soon", None, None),
    ],
)
def test_epoch(value, raw, kind, instant):
    got = value(clocks.decode_epoch, raw)
    assert (got.raw, got.epoch_type, got.utc) == (raw, kind, instant)


def test_epoch_hint(value):
    got = value(lambda c: clocks.decode_epoch(c, "webkit_us"), "11644473600000001")
    assert got.epoch_type == "webkit_us" and got.utc == datetime(1970, 1, 1, 0, 0, 0, 1)


@pytest.mark.parametrize(
    "typed, upper, bound",
    [
        ("2026-05-12", True, datetime(2026, 5, 12, 23, 59, 59, 999999)),
        ("2026-05-12", False, datetime(2026, 5, 12)),
        ("2026-5-2", False, datetime(2026, 5, 2)),
        ("12/05/2026", True, datetime(2026, 5, 12, 23, 59, 59, 999999)),
        ("2026-05-12T10:00:00+05:30", True, datetime(2026, 5, 12, 4, 30)),
        ("2026-05-12T10:00:00Z", True, datetime(2026, 5, 12, 10)),
    ],
)
def test_date_bounds(typed, upper, bound):
    assert clocks.parse_date_bound(typed, upper=upper) == bound.replace(tzinfo=timezone.utc)


def test_unreadable_bounds():
    assert clocks.parse_date_bound("last week", upper=True) is None
    assert clocks.parse_date_bound("", upper=True) is None
    assert clocks.parse_date_bound(None, upper=False) is None


@pytest.mark.parametrize("raw, label", [("1", "credit"), ("99", "code:99"), ("x", "code:x"), (None, None)])
def test_codes(value, raw, label):
    assert value(codes.txn_direction, raw) == label


def test_error_text(value):
    assert "passcode" in value(codes.error_message, "1103")
    assert value(codes.error_message, "") is None and value(codes.error_message, "5") is None


@pytest.mark.parametrize(
    "account, bank, branch",
    [("0000_HDFC0009999", "HDFC Bank", "009999"), ("0000_barb0fake01", "Bank of Baroda", "FAKE01"),
     ("0000_ZZZZ0009999", None, "009999"), (None, None, None), ("none", None, None)],
)
def test_bank_codes(value, account, bank, branch):
    assert value(codes.bank_name, account) == bank
    assert value(codes.bank_branch, account) == branch


def test_handles(value):
    assert value(parties.handle_user, "upiswiggy@icici") == "upiswiggy"
    assert "ICICI" in value(parties.handle_provider, "upiswiggy@ICICI")
    assert value(parties.handle_provider, "a@nowhere") == "nowhere"
    assert value(parties.handle_suffix, "plain") is None
    assert value(parties.looks_like_merchant, "swiggy1@x") is True
    assert value(parties.looks_like_merchant, "asha@x") is False


def test_name_keys(value):
    key = parties.party_name_key
    assert value(key, "Acme Foods Pvt Ltd") == value(key, "ACME FOODS Private Limited") == "acmefoods"
    assert value(key, "FoodCo") == value(key, "Foodco")
    assert value(key, "राम") is None and value(key, None) is None


def test_tokens(value):
    assert value(parties.last_token_rrn, "a,b, 100000000009 ") == "100000000009"
    assert value(parties.last_token_rrn, "100000000009,a") is None
    assert value(parties.first_token_mobile, "x, 9812345678,9812345679") == "9812345678"
    assert value(parties.first_token_mobile, "5812345678") is None


@pytest.mark.parametrize(
    "v, kind",
    [("a.b@ybl", "vpa"), ("9812345678", "phone"), ("100000000009", "rrn"), ("UPI12345678x", "txn_id"),
     ("hello", "text"), ("x", None), ("y" * 81, None)],
)
def test_identifier_kinds(value, v, kind):
    assert value(parties.identifier_kind, v) == kind


def test_ciphertext_shape(value):
    assert value(parties.ciphertext_shaped, "QUJD" * 20 + "==\n") is True
    assert value(parties.ciphertext_shaped, '{"a": "' + "QUJD" * 20 + '"}') is False
    assert value(parties.ciphertext_shaped, "QUJD" * 10) is False


def test_config(value):
    assert value(configtext.config_kind, "maxTxnAmount", "5") == "Threshold / limit"
    assert value(configtext.config_kind, "x", "TRUE") == "Feature flag (on/off)"
    assert value(configtext.config_kind, "abPercentage", "5") == "Experiment / rollout %"
    assert value(configtext.config_kind, "a", " [1]") == "Structured config (JSON)"
    assert value(configtext.config_meaning, "kycOtpTimeout_iOS") == "≈ KYC OTP Timeout"
    assert value(configtext.config_meaning, "AID").startswith("Application install ID")


def test_numbers(value):
    assert value(text.to_double, " 12.5 ") == 12.5 and value(text.to_double, "1e3") == 1000.0
    assert value(text.to_double, "12d") is None and value(text.to_double, "") is None
    assert value(text.to_bigint, "12.0") is None and value(text.to_bigint, "-7") == -7


def test_http_dates(value):
    assert value(clocks.http_date, "Tue, 05 Mar 2024 10:11:12 GMT") == datetime(2024, 3, 5, 10, 11, 12)
    assert value(clocks.http_date, "5 Mar 2024 10:11:12 +0530") == datetime(2024, 3, 5, 4, 41, 12)
    assert value(clocks.http_date, "tomorrow") is None


def test_markup_and_hex(value, spark):
    assert value(text.escape_markup, "<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert spark.range(1).select(text.hex_text(F.lit(bytearray(b"\x01\xff")))).first()[0] == "01ff"


# ---- secrets -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, hidden",
    [
        ('{"auth":"%s"}' % JWT, JWT),
        ('{"token":"dfMSsgIZRDahbnqgL0RPSr:APA91bGpHJGbW7xI8qaCVenxAzfQQQQQQ"}', "dfMSsg"),
        ("dfMSsgIZRDahbnqgL0RPSr:APA91bGpHJGbW7xI8qaCVenxAzfQQQQQQ", "APA91"),
        ("access_token=hunter2hunter2&x=1", "hunter2"),
        ("Authorization: Bearer abcdefghijklmnop", "abcdefgh"),
    ],
)
def test_secrets_are_cut_to_their_length(value, raw, hidden):
    got = value(secrets.redact_text, raw)
    assert hidden not in got and "<redacted:" in got


def test_secret_length_is_kept(value):
    assert value(secrets.redact_text, JWT) == f"<redacted:{len(JWT)} chars>"
    assert value(secrets.redact_value, "X_SESSION_KEY", "short") == "<redacted:5 chars>"
    assert value(secrets.is_secret_key, "counterparty_name") is False


@pytest.mark.parametrize(
    "plain",
    ["demoshop@bankx", "900000000001", "9876543210", "PYTM60527802669469514781", "0000_BARB0FAKE01",
     "https://pay.example.in/savedcardservice/x", "Sent you Rs 90 to FoodCo", "", None],
)
def test_ordinary_text_stays(value, plain):
    assert value(secrets.redact_text, plain) == plain


# ---- masks -------------------------------------------------------------------------------------


def test_every_sensitive_field_is_masked(spark):
    row = {
        "counterparty_name": "Acme Foods Pvt Ltd", "phone": "9876543210", "customer_id": "1000000001",
        "counterparty_mobile": "+91 98765 43210", "sendbird_id": "1900000000000000001", "device_id": "abc123",
        "counterparty_vpa": "acme-123@bankx", "rrn": "900000000001", "account_used": "0000_BANK0FAKE01",
        "ifsc_or_branch": "0318_BANK0001378", "account_bank": "Some Bank", "masked_account": "XXXX1234",
        "instrument": "Some Bank", "pincode": "500081",
    }
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    got = masks.mask_frame(df).first().asDict()
    import re

    for field, shown in got.items():
        assert "•" in shown and not re.search(r"\d{4}", shown), (field, shown)
        assert len(shown) == len(row[field])


def test_coordinates_stay_numbers(spark):
    df = spark.createDataFrame([(12.34567, 76.54321)], "latitude double, longitude double")
    got = masks.mask_frame(df).first()
    assert got.latitude == 12.3 and got.longitude == 76.5


def test_analysis_fields_are_untouched():
    for f in ("amount", "direction", "settled", "status_label", "utc", "confidence", "origin"):
        assert masks.field_rule(f) is None


def test_free_text(value):
    got = value(masks.mask_text, "Paid 9876543210 via alice@bankx IFSC BANK0001378, 12.34567, 76.54321")
    assert got == "Paid •••••••••• via •••••@••••• IFSC ••••0••••••, 12.3••••,76.5••••"
    assert value(masks.mask_text, "mail jo.doe+x@mail.example.com now") == "mail " + "•" * 25 + " now"
    assert value(masks.mask_text, '"displayName":"Asha Rao"') == '"displayName":"A••• R••"'
    assert value(masks.mask_text, "order 123456789 of 12345678901234567890") == (
        "order 123456789 of 12345678901234567890"
    )


def test_raw_rows_are_masked_by_key(spark):
    df = spark.createDataFrame([('{"vpa":"a.b@ybl","n":"call 9876543210","amount":"5"}',)], "raw string")
    got = masks.mask_frame(df).first().raw
    assert "9876543210" not in got and "a.b" not in got and '"amount":"5"' in got


def test_nested_records_are_masked(spark):
    df = spark.createDataFrame(
        [(["a@ybl", None], {"k": "v 9876543210"}, ("x",))],
        "vpas array<string>, value map<string,string>, provenance struct<source_file:string>",
    )
    got = masks.mask_frame(df).first()
    assert got.vpas == ["•@•••", None] and got.value == {"k": "v ••••••••••"}
    assert got.provenance.source_file == "x"


def test_known_names_in_texts(spark):
    from ledgerloom.operators.masking import mask_texts

    texts = spark.createDataFrame(
        [(1, "Paid Joanna and Ann Lee today"), (2, "nothing"), (3, "xAnn Leey and JoX"), (4, None)],
        "id int, body string",
    )
    names = spark.createDataFrame([("Ann Lee",), ("Ann",), ("Joanna",), ("Jo",)], "name string")
    names = names.where("length(name) > 2")
    got = {r.id: r.body for r in mask_texts(texts, "id", "body", names).collect()}
    assert got == {1: "Paid J••••• and A•• L•• today", 2: "nothing", 3: "xA•• L••y and JoX", 4: None}


# ---- chat --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "kind, content, status",
    [("TRANSFER_FAILED", "", "failed"), ("TRANSFER", "you declined it", "declined"),
     ("UPI_REQUEST", "", "requested"), ("REQUEST_RESPONSE", "", "success"), (None, "approved", "success"),
     (None, None, "")],
)
def test_payment_status(value, kind, content, status):
    assert value(chattext.payment_status, kind, content) == status


def test_documents_must_be_whole(spark):
    df = spark.createDataFrame(
        [('{"a":{"b":1}}',), ('{"a":1}x',), ('{"a":1},{"a":2}',), ("",), (None,), ('[{"a":"z"}]',)], "j string"
    )
    docs = text.with_document(df, "j", "d")
    got = [r.v for r in docs.select(text.in_document("d", ".a").alias("v")).collect()]
    assert got[0] == '{"b":1}' and got[1:] == [None] * 5
    head = docs.select(text.in_document("d", "[0].a").alias("v")).collect()
    assert head[5].v == "z"


def test_masks_try_their_patterns_only_where_they_can_match(spark):
    rows = ["mail a.b+c@d.example now", "no sign of it " * 20, "NAME: Ada Byron", "Account_Holder = Joe Ray", "by joe@icici", ""]
    frame = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    got = {r["id"]: r["masked"] for r in frame.select("id", masks.mask_text("text").alias("masked")).collect()}
    assert got == {
        0: "mail " + "•" * 15 + " now", 1: rows[1], 2: "NAME: A•• B••••", 3: "Account_Holder = J•• R••", 4: "by •••@•••••", 5: "",
    }


def test_an_email_is_the_same_whether_or_not_later_starts_are_tried(spark):
    pick = random.Random(4)
    rows = [("".join(pick.choices("aé_1.@+- ", [4, 1, 1, 1, 4, 3, 1, 1, 1], k=pick.randint(1, 24))),) for _ in range(5000)]
    every_start = rf"[{text.WORD}][{text.WORD}.+\-]*@[{text.WORD}\-]+\.[{text.WORD}.]+[{text.WORD}]"
    found = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (masks.EMAIL, every_start)]
    rows = spark.createDataFrame(rows, "t string").select("t", *found).collect()
    assert sum(bool(r[2]) for r in rows) > 100 and [r for r in rows if r[1] != r[2]] == []
