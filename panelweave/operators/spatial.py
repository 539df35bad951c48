"""Nearest neighbour within a distance, through a grid equi-join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import EARTH_RADIUS_M, haversine_m
from .grouping import salted_join
from .linkage import match_summary


def link_with_spatial(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    distance_threshold: float,
    left_coords: Sequence[str] = ("latitude", "longitude"),
    right_coords: Sequence[str] = ("latitude", "longitude"),
    source: str = "spatial",
) -> tuple[DataFrame, DataFrame]:
    """Add the nearest right key within ``distance_threshold`` metres.

    Points are reduced to distinct coordinates first, so any number of
    records at one spot counts as one point; ties go to the smallest key.
    """
    near = nearest_within(left, right, right_key, distance_threshold, left_coords, right_coords)
    lat, lon = left_coords
    linked = left.join(near.withColumnsRenamed({"lat_l": lat, "lon_l": lon}), [lat, lon], "left").select(
        *left.columns, "match_key", "distance_m"
    )
    return linked, match_summary(linked, right, "match_key", source, "spatial", f"{left_key},{right_key}")


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    right_key: str,
    distance_threshold: float,
    left_coords: Sequence[str],
    right_coords: Sequence[str],
) -> DataFrame:
    """Table (lat_l, lon_l, match_key, distance_m) of distinct left points.

    The search starts with a fine grid at a fraction of the threshold.  Only
    points without a partner there go on to the next, coarser grid, so dense
    areas are settled in small cells and wide cells meet few points.
    """
    lefts = left.select(*[F.col(c).alias(n) for c, n in zip(left_coords, ("lat_l", "lon_l"))]).dropna().distinct()
    spots = right.select(
        *[F.col(c).alias(n) for c, n in zip(right_coords, ("lat_r", "lon_r"))], F.col(right_key).alias("key_r")
    ).dropna(subset=["lat_r", "lon_r"])
    rights = spots.groupBy("lat_r", "lon_r").agg(F.min("key_r").alias("key_r"))
    fine = _nearest_in_grid(lefts, rights, distance_threshold / 8)
    open_left = lefts.join(fine.select("lat_l", "lon_l"), ["lat_l", "lon_l"], "left_anti")
    coarse = _nearest_in_grid(open_left, rights, distance_threshold)
    return fine.unionByName(coarse)


def _nearest_in_grid(lefts: DataFrame, rights: DataFrame, radius: float) -> DataFrame:
    """Nearest right point within ``radius``; all of them are in 9 cells."""
    step = math.degrees(radius / EARTH_RADIUS_M) * (1 + 1e-9)

    def row_of(lat: str) -> Column:
        return F.floor(F.col(lat) / step).cast("long")

    def columns_in(row: Column) -> Column:
        """Number of cells around the globe in a row, each wide enough there."""
        widest = F.greatest(F.abs((row - 1) * F.lit(step)), F.abs((row + 2) * F.lit(step)))
        shrink = F.cos(F.radians(F.least(widest, F.lit(90.0))))
        ratio = math.sin(radius / (2 * EARTH_RADIUS_M)) / F.greatest(shrink, F.lit(1e-12))
        width = F.when(ratio < 1, F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9)).otherwise(F.lit(360.0))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / width)).cast("long")

    def column_of(lon: str, count: Column) -> Column:
        return F.pmod(F.floor((F.col(lon) + 180.0) * count / 360.0), count).cast("long")

    placed = rights.withColumn("row", row_of("lat_r")).withColumn("col", column_of("lon_r", columns_in(F.col("row"))))
    rows = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: row_of("lat_l") + d)
    around = lefts.withColumn("row", F.explode(rows)).withColumn("n_cols", columns_in(F.col("row")))
    home = column_of("lon_l", F.col("n_cols"))
    cells = F.array_distinct(F.array(*[F.pmod(home + F.lit(d), F.col("n_cols")) for d in (-1, 0, 1)]))
    probing = around.withColumn("col", F.explode(cells))
    pairs = salted_join(probing, placed, ["row", "col"], ["lat_r", "lon_r"]).withColumn("d", haversine_m("lat_l", "lon_l", "lat_r", "lon_r"))
    inside = pairs.filter(F.col("d") <= radius)
    best = inside.groupBy("lat_l", "lon_l").agg(F.min(F.struct("d", "key_r")).alias("best"))
    return best.select("lat_l", "lon_l", F.col("best.key_r").alias("match_key"), F.col("best.d").alias("distance_m"))
