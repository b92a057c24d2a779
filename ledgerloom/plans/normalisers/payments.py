"""Payments: the passbook ledger, payments seen in chat, and the accounts behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import codes
from ...functions.clocks import decode_epoch
from ...functions.parties import first_token_mobile, last_token_rrn
from ...functions.text import (
    first_present,
    in_document,
    present,
    to_bigint,
    to_double,
    with_document,
)
from ...operators.ledger import chat_direction, chat_settled
from ...operators.skew import (
    anti_known,
    first_per_key,
    left_lookup,
    lookup_salted,
    lookup_weighted,
)
from .base import Sources, from_row, is_one, normaliser

PASSBOOK = r"^passbook\.db$"
CHAT = r"^chatDb\.db$"


@normaliser("transactions.passbook", "transaction")
def passbook(src: Sources) -> DataFrame:
    listing = src.rows(
        PASSBOOK, "UthListingEntity",
        "txnId", "sourceTxnId", "amount", "txnIndicator", "identifier", "secondPartyInfo",
        "statusKey", "narration", "remarks", "streamSource", "txnCategory", "txnDate", "txnTag",
        "userInstrumentInfo", "errorCode", "searchableStrings", "mobileNumber",
    )
    used = src.rows(
        PASSBOOK, "UthInstrumentEntity", "sourceTxnId", "instrumentName", "identifier", "accountType"
    ).where(present("sourceTxnId").isNotNull())
    instrument = first_per_key(
        used.select(
            "case_id",
            "sourceTxnId",
            "rowid",
            F.col("instrumentName").alias("inst_name"),
            F.col("identifier").alias("inst_id"),
            F.col("accountType").alias("inst_type"),
        ),
        ["case_id", "sourceTxnId"],
        ["rowid"],
        ["inst_name", "inst_id", "inst_type"],
    )
    t = left_lookup(listing, instrument, "sourceTxnId", ["case_id"])
    t = with_document(with_document(t, "userInstrumentInfo", "used"), "secondPartyInfo", "party")
    own = present("inst_id")

    def head(name: str) -> Column:
        return in_document("used", f"[0].{name}")

    t = t.withColumn("account", F.coalesce(own, head("identifier")))
    return t.select(
        "case_id",
        F.col("txnId").alias("txn_id"),
        F.col("sourceTxnId").alias("source_txn_id"),
        to_double("amount").alias("amount"),
        codes.txn_direction("txnIndicator").alias("direction"),
        F.col("identifier").alias("counterparty_vpa"),
        in_document("party", ".name").alias("counterparty_name"),
        F.coalesce(present("mobileNumber"), first_token_mobile("searchableStrings")).alias(
            "counterparty_mobile"
        ),
        last_token_rrn("searchableStrings").alias("rrn"),
        F.col("account").alias("account_used"),
        F.when(own.isNotNull(), F.col("inst_type")).otherwise(head("accountType")).alias(
            "account_type"
        ),
        codes.bank_name("account").alias("account_bank"),
        codes.bank_branch("account").alias("account_branch"),
        F.col("streamSource").alias("payment_mode"),
        F.col("statusKey").alias("status_raw"),
        codes.txn_status("statusKey").alias("status_label"),
        F.col("txnCategory").alias("category_raw"),
        codes.txn_category("txnCategory").alias("category_label"),
        F.col("txnTag").alias("tag"),
        first_present("narration", "remarks").alias("narration"),
        F.coalesce(present("inst_name"), head("instrumentName")).alias("instrument"),
        present("errorCode").alias("error_code"),
        codes.error_message("errorCode").alias("error_message"),
        F.coalesce(F.col("statusKey") == "2", F.lit(False)).alias("settled"),
        F.lit("passbook").alias("txn_source"),
        decode_epoch("txnDate").alias("timestamp"),
        from_row(),
        "raw",
    )


def subject_sender(src: Sources) -> DataFrame:
    """(case_id, subject_id): chat id of the device owner, from the first row marked as own."""
    own = src.rows(CHAT, "TBL_USERS", "isMe", "sendbirdUserId").where(is_one("isMe"))
    return first_per_key(own, ["case_id"], ["rowid"], ["sendbirdUserId"]).withColumnRenamed(
        "sendbirdUserId", "subject_id"
    )


def channel_party(src: Sources) -> DataFrame:
    """(case_id, channelUrl, party_name, party_phone, weight): first named member who is not the
    owner, and the number of messages in the channel."""
    users = src.rows(
        CHAT, "TBL_USERS", "userPrimaryKey", "sendbirdUserName", "name", "phoneNumber", "isMe"
    ).select(
        "case_id",
        "userPrimaryKey",
        "rowid",
        first_present("sendbirdUserName", "name").alias("party_name"),
        F.col("phoneNumber").alias("party_phone"),
        is_one("isMe").alias("own"),
    )
    users = users.groupBy("case_id", "userPrimaryKey").agg(
        F.max_by(F.struct("party_name", "party_phone", "own"), "rowid").alias("u")
    )
    users = users.where("u.party_name IS NOT NULL AND NOT u.own")
    members = src.rows(CHAT, "DBChannelUserEntryCrossRef", "channelUrl", "userPrimaryKey").where(
        present("channelUrl").isNotNull()
    )
    named = members.select("case_id", "channelUrl", "userPrimaryKey", "rowid").join(
        users, ["case_id", "userPrimaryKey"]
    )
    first = named.groupBy("case_id", "channelUrl").agg(
        F.min_by("u", F.struct("rowid", "userPrimaryKey")).alias("u")
    )
    sizes = (
        src.rows(CHAT, "ChatMessageEntity", "channelUrl")
        .groupBy("case_id", "channelUrl")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return first.join(sizes, ["case_id", "channelUrl"]).select(
        "case_id", "channelUrl", "u.party_name", "u.party_phone", "weight"
    )


def chat_amount(doc: str) -> Column:
    """``amount``, else ``displayAmount``; a JSON number 0 counts as not given, text "0" does not."""
    kind = F.schema_of_variant(in_document(doc, ".amount", "variant"))
    amount = present(in_document(doc, ".amount"))
    zero_number = (to_double(amount) == 0) & (kind != "STRING")
    return to_double(
        F.when(F.coalesce(~zero_number, F.lit(False)), amount).otherwise(
            in_document(doc, ".displayAmount")
        )
    )


@normaliser("transactions.chat", "transaction")
def chat_payments(src: Sources) -> DataFrame:
    """Chat payments that the passbook does not list; payments in both count once there."""
    messages = src.rows(
        CHAT, "ChatMessageEntity",
        "data", "messageContent", "senderName", "senderId", "createdAt", "customType", "channelUrl",
    )
    m = with_document(messages, "data", "doc")
    fields = {
        "txn_id": in_document("doc", ".txnId"),
        "source_txn_id": present(in_document("doc", ".uniqueKey")),
        "rrn": in_document("doc", ".rrn"),
        "status": F.upper(
            F.coalesce(present(in_document("doc", ".msgStatus")), present(in_document("doc", ".r_sts")))
        ),
        "payment_mode": in_document("doc", ".paymentMode"),
        "note": present(in_document("doc", ".note")),
        "amount": chat_amount("doc"),
    }
    m = m.withColumns(fields).drop("doc", "data").where("amount IS NOT NULL")
    listed = src.rows(PASSBOOK, "UthListingEntity", "sourceTxnId").where(
        present("sourceTxnId").isNotNull()
    )
    m = anti_known(m, listed, {"source_txn_id": "sourceTxnId"}, ("case_id",))
    m = lookup_salted(m, subject_sender(src), ["case_id"], ["rowid"])
    m = lookup_weighted(m, channel_party(src), ["case_id", "channelUrl"], "weight", "left")
    mine = present("subject_id").isNotNull() & (F.col("senderId") == F.col("subject_id"))
    return m.select(
        "case_id",
        "txn_id",
        "source_txn_id",
        "amount",
        chat_direction("customType", "status", "rrn", mine).alias("direction"),
        F.when(F.col("party_name").isNotNull(), F.col("party_name"))
        .otherwise(F.col("senderName"))
        .alias("counterparty_name"),
        F.col("party_phone").alias("counterparty_mobile"),
        "rrn",
        "payment_mode",
        F.col("status").alias("status_label"),
        F.col("messageContent").alias("narration"),
        "note",
        chat_settled("customType", "status").alias("settled"),
        F.lit("chat").alias("txn_source"),
        decode_epoch("createdAt").alias("timestamp"),
        from_row(),
        "raw",
    )


@normaliser("identity.account", "account")
def accounts(src: Sources) -> DataFrame:
    """One row per account identifier: its first instrument row."""
    rows = src.rows(
        PASSBOOK, "UthInstrumentEntity",
        "identifier", "instrumentName", "accountType", "maskedAccountNumber", "maskedAccNo",
        "instrumentType",
    ).where(present("identifier").isNotNull())
    rest = [c for c in rows.columns if c not in ("case_id", "identifier")]
    first = first_per_key(rows, ["case_id", "identifier"], ["rowid"], rest)
    return first.select(
        "case_id",
        F.coalesce(codes.bank_name("identifier"), F.col("instrumentName")).alias("bank_name"),
        F.col("identifier").alias("ifsc_or_branch"),
        F.col("accountType").alias("account_type"),
        first_present("maskedAccountNumber", "maskedAccNo").alias("masked_number"),
        to_bigint("instrumentType").alias("instrument_type"),
        from_row(),
        "raw",
    )
