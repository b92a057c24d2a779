"""People and merchants: records that share an identifier become one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parties import party_name_key
from ..functions.text import present
from ..session import cut_lineage
from .components import label_records
from .ledger import money
from .skew import join_heavy, value_sets

ATTRIBUTES = {
    "names": "name",
    "phones": "phone",
    "vpas": "vpa",
    "customer_ids": "customer_id",
    "sendbird_ids": "sendbird_id",
    "source_files": "source_file",
}


def record_id(*cols) -> F.Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def person_records(person: DataFrame) -> DataFrame:
    prov = F.col("provenance")
    return person.select(
        "case_id",
        record_id(
            F.col("case_id"), prov["source_file"], prov["source_table"], prov["rowid"],
            F.col("name"), F.col("phone"), F.col("customer_id"), F.to_json("vpas"),
        ).alias("record_id"),
        F.struct(prov["source_file"].alias("f"), prov["rowid"].alias("r")).alias("seq"),
        present("name").alias("name"),
        present("phone").alias("phone"),
        F.filter("vpas", lambda v: F.coalesce(v, F.lit("")) != "").alias("vpas"),
        present("customer_id").alias("customer_id"),
        present("sendbird_id").alias("sendbird_id"),
        present("person_type").alias("person_type"),
        F.coalesce("is_subject", F.lit(False)).alias("is_subject"),
        present("account_age_text").alias("account_age_text"),
        present(prov["source_file"]).alias("source_file"),
        F.lit(None).cast("string").alias("seed_key"),
    )


def join_keys(records: DataFrame, node: str = "record_id") -> DataFrame:
    """(case_id, node, kind, value) of everything two records may share."""
    options = [
        F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        for kind, value in (
            ("cid", F.col("customer_id")),
            ("phone", F.col("phone")),
            ("sb", F.col("sendbird_id")),
            ("name", party_name_key("name")),
            ("seed", F.col("seed_key")),
        )
    ]
    handles = F.transform(
        F.coalesce("vpas", F.array().cast("array<string>")),
        lambda v: F.struct(F.lit("vpa").alias("kind"), v.alias("value")),
    )
    return (
        records.select(
            "case_id", node, F.explode(F.concat(F.array(*options), handles)).alias("k")
        )
        .select("case_id", node, "k.kind", "k.value")
        .where("value IS NOT NULL")
        .distinct()
    )


def ledger_parties(txns: DataFrame) -> DataFrame:
    """Distinct counterparties of the ledger with their totals: small before anything is joined."""
    settled = F.coalesce("settled", F.lit(False))
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        txns.select(
            "case_id",
            present("counterparty_vpa").alias("vpa"),
            present("counterparty_name").alias("name"),
            present("counterparty_mobile").alias("phone"),
            F.when(settled & (F.col("direction") == "credit"), money("amount"))
            .otherwise(zero)
            .alias("received"),
            F.when(settled & (F.col("direction") == "debit"), money("amount"))
            .otherwise(zero)
            .alias("paid"),
            F.col("provenance.source_file").alias("source_file"),
        )
        .groupBy("case_id", "vpa", "name", "phone")
        .agg(
            F.count(F.lit(1)).alias("txn_count"),
            F.sum("received").alias("received"),
            F.sum("paid").alias("paid"),
            F.min("source_file").alias("source_file"),
        )
        .withColumn("name_key", party_name_key("name"))
    )


#: the identifiers of a counterparty, strongest first
PARTY_KEYS = (("vpa", "vpa"), ("name", "name_key"), ("phone", "phone"))


def _party_keys(parties: DataFrame) -> DataFrame:
    """Parties once per identifier they carry, with its rank: one join then serves all kinds."""
    options = [
        F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col(c).alias("value"))
        for rank, (kind, c) in enumerate(PARTY_KEYS)
    ]
    carried = F.filter(F.array(*options), lambda k: k["value"].isNotNull())
    return parties.select("*", F.explode_outer(carried).alias("k")).select(
        *parties.columns, "k.rank", "k.kind", "k.value"
    )


def seed_parties(parties: DataFrame, people_keys: DataFrame) -> DataFrame:
    """Counterparties that share no handle, name or phone with any known person."""
    known = people_keys.where(F.col("kind").isin([k for k, _ in PARTY_KEYS]))
    known = known.select("case_id", "kind", "value").distinct().withColumn("_known", F.lit(True))
    identity = ["case_id", "vpa", "name", "phone", "name_key", "source_file"]
    unknown = (
        join_heavy(_party_keys(parties.select(*identity)), known, ["case_id", "kind", "value"], "left")
        .groupBy(*identity)
        .agg(F.bool_or(F.coalesce("_known", F.lit(False))).alias("_known"))
        .where(~F.col("_known"))
    )
    group = (
        F.when(F.col("vpa").isNotNull(), F.concat(F.lit("vpa:"), F.col("vpa")))
        .when(
            F.col("name").isNotNull(),
            F.concat(F.lit("name:"), F.coalesce("name_key", F.lower("name"))),
        )
        .when(F.col("phone").isNotNull(), F.concat(F.lit("phone:"), F.col("phone")))
    )
    nothing = F.lit(None).cast("string")
    return unknown.withColumn("seed_key", group).where("seed_key IS NOT NULL").select(
        "case_id",
        record_id(
            F.col("case_id"), F.lit("ledger"), F.col("vpa"), F.col("name"), F.col("phone")
        ).alias("record_id"),
        F.struct(F.lit("~ledger").alias("f"), F.lit(None).cast("bigint").alias("r")).alias("seq"),
        "name",
        "phone",
        F.array_compact(F.array("vpa")).alias("vpas"),
        nothing.alias("customer_id"),
        nothing.alias("sendbird_id"),
        nothing.alias("person_type"),
        F.lit(False).alias("is_subject"),
        nothing.alias("account_age_text"),
        F.col("source_file"),
        "seed_key",
    )


def attribute(parties: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner of each ledger party: by handle, else by name, else by phone.

    ``owners`` is (case_id, kind, value, component). Parties are one row per identifier combination; a name that
    many handles share is still a hot key, and is cut by :func:`~.skew.join_heavy`.
    """
    best = F.min_by("component", F.when(F.col("component").isNotNull(), F.col("rank")))
    return (
        join_heavy(_party_keys(parties), owners, ["case_id", "kind", "value"])
        .groupBy(*parties.columns)
        .agg(best.alias("component"))
    )


def entity_table(person: DataFrame, txns: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per entity, with all values of each kind."""
    people = person_records(person)
    # these three tables are read several times below, so each is written once
    parties = cut_lineage(ledger_parties(txns))
    seeds = seed_parties(parties, join_keys(people))
    records = cut_lineage(people.unionByName(seeds))
    keys = cut_lineage(join_keys(records))
    labelled = cut_lineage(
        label_records(records, keys, "record_id", ["case_id", "kind", "value"])
    )

    owners = (
        join_keys(labelled, "component").select("case_id", "kind", "value", "component").distinct()
    )
    totals = (
        attribute(parties, owners)
        .groupBy("component")
        .agg(F.sum("txn_count").alias("txn_count"), F.sum("received").alias("r"),
             F.sum("paid").alias("p"))
    )
    senders = messages.where(F.coalesce("sender_id", F.lit("")) != "").groupBy(
        "case_id", F.col("sender_id").alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))
    spoken = (
        senders.join(owners.where("kind = 'sb'"), ["case_id", "value"])
        .groupBy("component")
        .agg(F.sum("n").alias("msg_count"))
    )
    facts = labelled.groupBy("component").agg(
        F.first("case_id").alias("case_id"),
        F.min_by("person_type", F.when(F.col("person_type").isNotNull(), F.col("seq"))).alias(
            "person_type"
        ),
        F.min_by(
            "account_age_text", F.when(F.col("account_age_text").isNotNull(), F.col("seq"))
        ).alias("account_age_text"),
        F.bool_or("is_subject").alias("is_subject"),
    )
    profile = facts.join(totals, "component", "left").join(spoken, "component", "left")
    sets = _attribute_sets(labelled)
    empty = F.array().cast("array<string>")
    return profile.join(sets, "component", "left").select(
        "case_id",
        F.col("component").alias("entity_id"),
        *[F.coalesce(c, empty).alias(c) for c in ATTRIBUTES],
        "person_type",
        "is_subject",
        "account_age_text",
        F.coalesce("txn_count", F.lit(0)).alias("txn_count"),
        F.coalesce(F.col("r").cast("double"), F.lit(0.0)).alias("total_received"),
        F.coalesce(F.col("p").cast("double"), F.lit(0.0)).alias("total_paid"),
        F.coalesce("msg_count", F.lit(0)).alias("msg_count"),
    )


def _attribute_sets(labelled: DataFrame) -> DataFrame:
    single = [
        F.struct(F.lit(out).alias("attribute"), F.col(column).alias("value"))
        for out, column in ATTRIBUTES.items()
        if column != "vpa"
    ]
    listed = F.coalesce("vpas", F.array().cast("array<string>"))
    handles = F.transform(listed, lambda v: F.struct(F.lit("vpas").alias("attribute"), v.alias("value")))
    long = labelled.select(
        "component", F.explode(F.concat(F.array(*single), handles)).alias("a")
    ).select("component", "a.attribute", "a.value")
    parts = value_sets(long, ["component", "attribute"], "value", "part")
    return parts.groupBy("component").agg(
        *[F.max_by("part", F.when(F.col("attribute") == a, F.lit(1))).alias(a) for a in ATTRIBUTES]
    )
