"""People: the device owner, chat users, cached handles and the contact store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import first_present, nested_json_text, present
from ...operators.skew import first_per_key, lookup_salted
from ...schemas import provenance
from .base import Sources, from_row, is_one, normaliser
from .payments import CHAT


def account_age() -> Column:
    return nested_json_text(
        first_present("getInfoSync", "getPaymentInfoSync"), "$.jsonString", "$.customerCreationText"
    )


def one_handle(*columns: str) -> Column:
    return F.array_compact(F.array(*[present(c) for c in columns]))


@normaliser("identity", "person")
def owner(src: Sources) -> DataFrame:
    """One owner per case, out of the secure settings and the own row of the user table."""
    wanted = ("userId", "resId", "mobile", "kyc_state", "ppb_bank_type", "is_upi_user", "acc_status")
    prefs = (
        src.settings(r"(^|/)bank_secure_prefs\.xml$")
        .groupBy("case_id")
        .agg(
            F.min("path").alias("path"),
            F.min("sha256").alias("sha256"),
            *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in wanted],
        )
    )
    users = src.rows(
        CHAT, "TBL_USERS",
        "isMe", "sendbirdUserName", "name", "sendbirdUserId", "phoneNumber", "bankName",
        "user_bank_model_primaryBankName", "getInfoSync", "getPaymentInfoSync",
    ).where(is_one("isMe"))
    rest = [c for c in users.columns if c not in ("case_id", "raw", "sha256")]
    own = first_per_key(users, ["case_id"], ["rowid"], rest)
    both = prefs.join(own, "case_id", "full")
    phone = first_present("mobile", "phoneNumber")
    return both.select(
        "case_id",
        first_present("userId", "resId").alias("customer_id"),
        first_present("sendbirdUserName", "name").alias("name"),
        phone.alias("phone"),
        F.when(phone.isNotNull(), "91").alias("country_code"),
        F.array().cast("array<string>").alias("vpas"),
        F.lit("CUSTOMER").alias("person_type"),
        F.lit(True).alias("is_subject"),
        account_age().alias("account_age_text"),
        F.col("sendbirdUserId").alias("sendbird_id"),
        first_present("bankName", "user_bank_model_primaryBankName").alias("bank_name"),
        provenance(
            F.coalesce("path", "source_file"), "bank_secure_prefs/TBL_USERS", sha256=F.col("sha256"),
            read_mode=F.col("read_mode"),
        ).alias("provenance"),
        F.to_json(F.struct(*[c for c in wanted if c != "resId"])).alias("raw"),
    )


@normaliser("contacts.users", "person")
def chat_users(src: Sources) -> DataFrame:
    users = src.rows(
        CHAT, "TBL_USERS",
        "isMe", "identifier", "sendbirdUserName", "name", "phoneNumber", "vpa", "type",
        "getInfoSync", "getPaymentInfoSync", "sendbirdUserId", "bankName", "maskedAccNo",
        "verifiedName",
    ).where(~is_one("isMe"))
    return users.select(
        "case_id",
        F.col("identifier").alias("customer_id"),
        first_present("sendbirdUserName", "name").alias("name"),
        F.col("phoneNumber").alias("phone"),
        one_handle("vpa").alias("vpas"),
        F.col("type").alias("person_type"),
        F.lit(False).alias("is_subject"),
        account_age().alias("account_age_text"),
        F.col("sendbirdUserId").alias("sendbird_id"),
        F.col("bankName").alias("bank_name"),
        F.col("maskedAccNo").alias("masked_account"),
        F.col("verifiedName").alias("verified_name"),
        from_row(),
        "raw",
    )


@normaliser("contacts.vpa_cache", "person")
def cached_handles(src: Sources) -> DataFrame:
    rows = src.rows(
        r"^cache_database$", "cache_table", "vpa", "name", "verified_name", "is_verified_merchant"
    )
    return rows.select(
        "case_id",
        "name",
        one_handle("vpa").alias("vpas"),
        F.when(is_one("is_verified_merchant"), "MERCHANT").alias("person_type"),
        F.lit(False).alias("is_subject"),
        "verified_name",
        from_row(),
        "raw",
    )


CONTACTS = r"^contacts$"
#: spellings of the main table; the first one a case has is used
CONTACT_TABLES = ("contacts", "contact", "Contact")


@normaliser("contacts.db", "person")
def contact_store(src: Sources) -> DataFrame:
    """Contacts with their first phone number and their last enrichment row."""
    phones = src.rows(
        CONTACTS, "contacts_phones",
        "contact_id", "contactId", "id", "phone", "number", "phone_number",
    ).select(
        "case_id", "rowid",
        first_present("contact_id", "contactId", "id").alias("cid"),
        first_present("phone", "number", "phone_number").alias("listed_phone"),
    )
    phones = first_per_key(
        phones.where("cid IS NOT NULL AND listed_phone IS NOT NULL"),
        ["case_id", "cid"], ["rowid"], ["listed_phone"],
    )
    extra = src.rows(
        CONTACTS, "enrichment_data",
        "contact_id", "id", "customer_id", "name", "vpa", "verified_name",
    ).withColumn("cid", first_present("contact_id", "id"))
    extra = (
        extra.where("cid IS NOT NULL")
        .groupBy("case_id", "cid")
        .agg(
            F.max_by(
                F.struct(
                    F.col("customer_id").alias("e_customer_id"),
                    F.col("name").alias("e_name"),
                    F.col("vpa").alias("e_vpa"),
                    F.col("verified_name").alias("e_verified"),
                ),
                "rowid",
            ).alias("e")
        )
        .select("case_id", "cid", "e.*")
    )
    main = src.any_table(CONTACTS, "^(contacts|contact|Contact)$")
    spelling = F.array_position(F.array(*[F.lit(t) for t in CONTACT_TABLES]), F.col("source_table"))
    # per case the best spelling that occurs, as a small aggregate rather than a window
    best = main.groupBy("case_id").agg(F.min(spelling).alias("_best"))
    main = lookup_salted(main, best, ["case_id"], ["rowid"]).where(spelling == F.col("_best"))
    r = F.col("row")
    main = main.withColumn(
        "cid", F.coalesce(present(r["id"]), present(r["contact_id"]), F.col("rowid").cast("string"))
    )
    joined = main.join(phones, ["case_id", "cid"], "left").join(extra, ["case_id", "cid"], "left")
    return joined.select(
        "case_id",
        F.coalesce(present(r["customer_id"]), present("e_customer_id")).alias("customer_id"),
        F.coalesce(present(r["name"]), present(r["display_name"]), F.col("e_name")).alias("name"),
        F.coalesce("listed_phone", present(r["phone"]), present(r["number"])).alias("phone"),
        F.array_compact(F.array(present(r["vpa"]), present("e_vpa"))).alias("vpas"),
        F.coalesce(present(r["type"]), F.lit("CONTACT")).alias("person_type"),
        F.lit(False).alias("is_subject"),
        F.col("e_verified").alias("verified_name"),
        from_row(),
        "raw",
    )
