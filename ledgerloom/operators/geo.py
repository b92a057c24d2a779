"""Location evidence, bounding boxes and map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import iso_time
from ..functions.masks import blur_coordinate
from ..session import cut_lineage
from .skew import scan_in_order


def fixes(location: DataFrame, diagnostic: DataFrame, masked: bool = False) -> DataFrame:
    """Both kinds of location evidence with coordinates; blurred before anything leaves."""

    def one(df: DataFrame, source: Column) -> DataFrame:
        blur = blur_coordinate if masked else F.col
        return df.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(
            "case_id",
            blur("latitude").alias("lat"),
            blur("longitude").alias("lon"),
            source.alias("source"),
            F.col("timestamp.utc").alias("utc"),
            F.struct("provenance.source_file", "provenance.rowid").alias("seq"),
        )

    return one(location, F.coalesce("source_kind", F.lit("signal"))).unionByName(
        one(diagnostic, F.lit("diagnostic"))
    )


def position(lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    return F.struct(F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


def position_counts(points: DataFrame, by: list[str]) -> DataFrame:
    """Fixes and distinct positions per group. Positions are made distinct first, so a hot group
    is counted from its distinct rows only."""
    per_place = points.groupBy(*by, position().alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return per_place.groupBy(*by).agg(
        F.sum("n").alias("n_fixes"), F.count(F.lit(1)).alias("n_positions")
    )


def has_path() -> Column:
    """Identical points are not a journey."""
    return (F.col("n_fixes") > 1) & (F.col("n_positions") > 2)


def path_segments(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The movement path as (previous, current) pairs: a path of any length stays distributed."""
    steps = scan_in_order(points, by, order, {"from_lat": "lat", "from_lon": "lon"})
    return steps.where("from_lat IS NOT NULL")


def geojson_features(points: DataFrame) -> DataFrame:
    """GeoJSON features as text rows: a Point per fix and a LineString per step of a real path. The fixes are
    written once as a reliable checkpoint, as counts, order and features each read them."""
    points = cut_lineage(points)
    point = points.select(
        "case_id",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(
                    F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")
                ).alias("geometry"),
                F.struct(
                    F.col("source"),
                    F.coalesce(iso_time("utc"), F.lit("")).alias("timestamp_utc"),
                ).alias("properties"),
            )
        ).alias("value"),
    )
    counts = position_counts(points, ["case_id"]).where(has_path())
    timed = points.withColumn("order_utc", F.coalesce("utc", F.lit("0001-01-01").cast("timestamp")))
    steps = path_segments(timed, ["case_id"], ["order_utc", "seq"])
    # one small row per case: broadcast where they are few, else adaptive execution splits a hot case
    steps = steps.join(counts, "case_id")
    line = steps.select(
        "case_id",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(
                    F.lit("LineString").alias("type"),
                    F.array(F.array("from_lon", "from_lat"), F.array("lon", "lat")).alias(
                        "coordinates"
                    ),
                ).alias("geometry"),
                F.struct(
                    F.lit("movement_path").alias("name"),
                    F.col("n_positions").alias("distinct_positions"),
                ).alias("properties"),
            )
        ).alias("value"),
    )
    return point.unionByName(line)


def bounding_box(points: DataFrame, by: list[str], least_span: float = 0.02, pad: float = 0.01):
    box = points.groupBy(*by).agg(
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )
    narrow_lat = F.col("max_lat") - F.col("min_lat") < least_span
    narrow_lon = F.col("max_lon") - F.col("min_lon") < least_span

    def padded(name: str, narrow: Column, step: float) -> Column:
        return F.when(narrow, F.col(name) + step).otherwise(F.col(name)).alias(name)

    return box.select(
        *by,
        padded("min_lat", narrow_lat, -pad),
        padded("max_lat", narrow_lat, pad),
        padded("min_lon", narrow_lon, -pad),
        padded("max_lon", narrow_lon, pad),
    )
