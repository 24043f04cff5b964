"""Segmentation pipelines on top of the seeded watershed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import BLOCK
from voxelloom.operators.components import components, size_filter
from voxelloom.operators.distance import distance, height_map
from voxelloom.operators.flood import VOXEL, watershed
from voxelloom.operators.morphology import clean_objects
from voxelloom.session import cut


@dataclass(frozen=True)
class SegParams:
    """One named set of segmentation parameters."""

    fg_threshold: float = 0.5
    bd_threshold: float = 0.25
    seed_distance: float | None = 6.0
    seed_difference: float | None = None
    seed_connectivity: int = 6
    seed_min_size: int = 0
    penalty: float | None = 2.0
    barrier_fg_threshold: float | None = None
    height: str = "distance"
    mask: str = "sum"
    mask_threshold: float = 0.5
    min_size: int = 250
    flood: bool = True
    clean: tuple[int, int, int] | None = None  # hole area, 3-D and in-plane closing steps


# Parameter sets that go with the published runs.
PRESETS = {
    "out_of_core": SegParams(),
    "in_core": SegParams(fg_threshold=0.85, bd_threshold=0.15, seed_distance=4.0, seed_connectivity=18, seed_min_size=2000,
                         penalty=None, mask="sum_low_boundary", min_size=2000, clean=(500, 4, 8)),
    "axon": SegParams(seed_distance=None, min_size=2000, flood=False),
    "from_prediction": SegParams(penalty=None, min_size=400_000),
    "channel_difference": SegParams(seed_distance=None, seed_difference=0.6, height="boundary", mask="max", min_size=15_000),
    "decoder": SegParams(bd_threshold=0.5, seed_distance=None, height="boundary", mask="foreground", min_size=0),
}


def boundary_distance(vox: DataFrame, volumes: DataFrame, params: SegParams, radius: int = 8, block=BLOCK) -> DataFrame:
    """Distance inside the boundary threshold, materialised; the same for all parameters with that threshold."""
    return cut(distance(vox.where(F.col("bd") < params.bd_threshold), volumes, radius, block=block))


def segment(vox: DataFrame, volumes: DataFrame, params: SegParams, radius: int = 8, block=BLOCK, dist: DataFrame | None = None) -> DataFrame:
    """Instance labels from foreground and boundary probabilities.

    ``vox``: one row per voxel with ``fg`` and ``bd``.  Labels are the packed
    first-voxel ids of the seed components.  ``dist``: ``boundary_distance`` where it is known already.
    """
    fg, bd = F.col("fg"), F.col("bd")
    if not params.flood:
        mask = vox.where(fg > params.fg_threshold).select(*VOXEL, F.lit(1).cast("long").alias("label"))
        parts = components(mask, 26, False, block).select(*VOXEL, (F.col("component") + 1).alias("label"))
        return size_filter(parts, params.min_size)

    seed_rule = fg > params.fg_threshold
    rows = vox.select(*VOXEL, "fg", "bd")
    if params.height == "distance":
        dist = boundary_distance(vox, volumes, params, radius, block) if dist is None else dist
        rows = cut(height_map(rows, dist, "fg", "bd", params.penalty, params.bd_threshold, params.barrier_fg_threshold))
    else:
        rows = rows.withColumn("height", bd)
    if params.seed_distance is not None:
        seed_rule = seed_rule & (F.col("dist") > params.seed_distance)
    elif params.seed_difference is not None:
        seed_rule = (fg - bd) > params.seed_difference
    else:
        seed_rule = seed_rule & (bd < params.bd_threshold)
    seeds = rows.where(seed_rule).select(*VOXEL, F.lit(1).cast("long").alias("label"))
    seeds = components(seeds, params.seed_connectivity, False, block).select(*VOXEL, (F.col("component") + 1).alias("label"))
    if params.seed_min_size:
        seeds = size_filter(seeds, params.seed_min_size)
    inside = {
        "sum": fg + bd,
        "sum_low_boundary": fg + F.when(bd < params.bd_threshold, bd).otherwise(F.lit(0.0)),
        "max": F.greatest(fg, bd),
        "foreground": fg,
    }[params.mask]
    flooded = watershed(rows.where(inside > params.mask_threshold), seeds, block)
    if params.min_size:
        flooded = size_filter(flooded, params.min_size)
    return clean_objects(flooded, *params.clean, block=block) if params.clean else flooded
