"""Configuration, preferences and capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.configtext import config_kind, config_meaning
from ...functions.secrets import redact_setting, redact_text, redact_value
from ...functions.text import json_text
from ...sources.files import printable_strings
from .base import Sources, from_file, from_row, normaliser


def _config(key: str, value: str, *more: Column) -> list[Column]:
    return [
        F.col("case_id"),
        F.col(key).alias("key"),
        config_kind(key, value).alias("kind"),
        config_meaning(key).alias("meaning"),
        *more,
    ]


@normaliser("config.appmanager", "config")
def app_config(src: Sources) -> DataFrame:
    rows = src.rows(r"^appManagerDB$", "ItemTable", "keyValue", "value")
    shown = redact_value("keyValue", "value").alias("value")
    return rows.select(*_config("keyValue", "value", shown), from_row(), "raw")


def changed_from_default(rows: DataFrame, defaults: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``is_changed_from_default``; null where the defaults do not list the key.

    ``defaults`` (key, default_value) ships with the app: a few thousand rows at most, which is
    checked before it is broadcast.
    """
    dim = defaults.select(
        F.col("key").alias(key), "default_value", F.lit(True).alias("_listed")
    )
    small = dim.limit(100_001).count() <= 100_000
    joined = rows.join(F.broadcast(dim) if small else dim, key, "left")
    changed = F.when(
        F.col("_listed"), ~F.col(value).eqNullSafe(F.col("default_value"))
    )
    return joined.withColumn("is_changed_from_default", changed).drop("default_value", "_listed")


@normaliser("config.bank", "config")
def bank_config(src: Sources) -> DataFrame:
    rows = src.rows(r"^bank_app_manager_database$", "bankAppManagerTable", "key", "value")
    if src.bank_defaults is None:
        rows = rows.withColumn("is_changed_from_default", F.lit(None).cast("boolean"))
    else:
        rows = changed_from_default(rows, src.bank_defaults, "key", "value")
    shown = redact_value("key", "value").alias("value")
    return rows.select(
        *_config("key", "value", shown, F.col("is_changed_from_default")), from_row(), "raw"
    )


def read_defaults(spark, path: str) -> DataFrame:
    """Default settings from their JSON file: ``response.list[].{key,value}``."""
    text = spark.read.text(path, wholetext=True)
    schema = "struct<response:struct<list:array<struct<key:string,value:string>>>>"
    items = text.select(F.explode(F.from_json("value", schema)["response"]["list"]).alias("e"))
    return items.select("e.key", F.col("e.value").alias("default_value")).dropDuplicates(["key"])


#: encrypted stores are catalogued, not read as settings
SEALED = ("Data.xml", "DataUPI.xml", "DataERUPEE.xml")


@normaliser("prefs", "pref")
def preferences(src: Sources) -> DataFrame:
    rows = src.settings(r"^shared_prefs/.*\.(?i:xml)$").where(~F.col("name").isin(*SEALED))
    return rows.select(
        "case_id",
        "key",
        redact_setting("key", "value").alias("value"),
        F.col("name").alias("pref_file"),
        from_file(),
        F.to_json(F.struct("key")).alias("raw"),
    )


@normaliser("files.datastore", "pref")
def datastore(src: Sources) -> DataFrame:
    """Binary preference stores as an inventory of their strings; the codec is not decoded."""
    files = src.files(r"^files/datastore|\.preferences_pb$")
    strings = printable_strings("content", 5)
    listed = F.coalesce(F.nullif(F.array_join(strings, " | "), F.lit("")), F.lit("(empty)"))
    return files.select(
        "case_id",
        F.col("name").alias("key"),
        redact_text(listed).alias("value"),
        F.lit("files/datastore (protobuf, best-effort)").alias("pref_file"),
        from_file(0.6),
    )


_FLAT = "map<string,string>"


def _document(content: str = "content") -> Column:
    return F.decode(content, "UTF-8")


@normaliser("files.firebase_installation", "pref")
def installation_ids(src: Sources) -> DataFrame:
    files = src.files("PersistedInstallation")
    pairs = files.select("*", F.explode(F.from_json(_document(), _FLAT)).alias("key", "v"))
    return pairs.select(
        "case_id",
        "key",
        redact_value("key", "v").alias("value"),
        F.col("name").alias("pref_file"),
        from_file(),
        F.to_json(F.struct("key")).alias("raw"),
    )


def remote_flags(files: DataFrame) -> DataFrame:
    """(…, key, v) of remote configuration: the flag map, else the scalar top-level entries."""
    doc = _document()
    flags = F.from_json(json_text(doc, "$.configs_key"), _FLAT)
    flat = F.map_filter(F.from_json(doc, _FLAT), lambda k, v: ~v.rlike(r"^\s*[\[{]"))
    return files.select("*", F.explode(F.coalesce(flags, flat)).alias("key", "v"))


@normaliser("files.remote_config", "config")
def remote_config(src: Sources) -> DataFrame:
    rows = remote_flags(src.files(r"(^|/)frc_[^/]*\.json$"))
    raw = F.to_json(F.struct("key")).alias("raw")
    return rows.select(*_config("key", "v", F.col("v").alias("value")), from_file(), raw)


# Filter parameters that stand for a feature, and flag names that do.
FEATURE_FILTERS = {
    "paymentSystem": "Payment instrument",
    "mandateFilter": "Automatic payments",
    "verticalName": "Orders & bookings vertical",
}
FEATURE_FLAGS = r"(?i)mandate|ipo|reserve|pocket|autopay|recurring|split|trading|postpaid"

_FILTERS = (
    "array<struct<requestParam:string,values:array<struct<displayName:string,"
    "requestParamValue:string,isActive:string>>>>"
)


@normaliser("capabilities", "capability")
def capabilities(src: Sources) -> DataFrame:
    """Features the account may use: server endpoints, filter values and remote flags."""
    files = src.files(r"(^|/)uthSearchFilterMetaData1\.json$").withColumn("doc", _document())
    endpoints = files.select(
        "*", F.explode(F.from_json(json_text("doc", "$.apiUrlsInfo"), _FLAT)).alias("k", "v")
    ).select(
        "case_id",
        F.lit("Server API endpoint").alias("category"),
        F.col("k").alias("name"),
        F.col("v").alias("value"),
        F.lit(True).alias("available"),
        from_file(),
    )
    category = F.create_map(*[F.lit(x) for kv in FEATURE_FILTERS.items() for x in kv])
    filters = files.select(
        "case_id", "path", "sha256",
        F.explode(F.from_json(json_text("doc", "$.filters"), _FILTERS)).alias("f"),
    ).select("*", F.element_at(category, F.col("f.requestParam")).alias("category"))
    active = F.lower(F.coalesce("v.isActive", F.lit("false")))
    values = (
        filters.where("category IS NOT NULL")
        .select("*", F.explode("f.values").alias("v"))
        .select(
            "case_id",
            "category",
            F.col("v.displayName").alias("name"),
            F.col("v.requestParamValue").alias("value"),
            (~active.isin("false", "0", "", "null")).alias("available"),
            from_file(),
        )
    )
    activated = remote_flags(src.files(r"_firebase_activate\.json$"))
    flags = activated.where(F.col("key").rlike(FEATURE_FLAGS)).select(
        "case_id",
        F.lit("Feature flag (remote config)").alias("category"),
        F.col("key").alias("name"),
        F.col("v").alias("value"),
        (F.lower("v") == "true").alias("available"),
        from_file(),
    )
    return endpoints.unionByName(values).unionByName(flags)
