"""Filling slices between annotated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_slices(flags: DataFrame) -> DataFrame:
    """Closest annotated slice before and after each slice.

    ``flags``: volume_id, z, has.  The window runs over slices, not voxels, so
    a partition holds at most the depth of one volume.
    """
    by = Window.partitionBy("volume_id").orderBy("z")
    hit = F.when(F.col("has"), F.col("z"))
    return flags.select(
        "*", F.last(hit, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before_z"),
        F.first(hit, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("after_z"))


def fill_z_gaps(mask: DataFrame, volumes: DataFrame, max_gap: int | None = None) -> DataFrame:
    """Empty slices between two annotated ones get the union of both.

    Never extends past the first or last annotated slice.
    """
    used = mask.select("volume_id", "z").distinct().withColumn("has", F.lit(True))
    every = volumes.select("volume_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nz") - 1)).alias("z"))
    flags = every.join(used, ["volume_id", "z"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    gaps = nearest_slices(flags).where(~F.col("has") & F.col("before_z").isNotNull() & F.col("after_z").isNotNull())
    if max_gap is not None:
        gaps = gaps.where(F.col("after_z") - F.col("before_z") - 1 <= max_gap)
    source = gaps.select("volume_id", F.col("z").alias("_to"), F.explode(F.array("before_z", "after_z")).alias("z"))
    copied = mask.join(source, ["volume_id", "z"]).select("volume_id", F.col("_to").alias("z"), "y", "x").distinct()
    return mask.select("volume_id", "z", "y", "x").unionByName(copied)
