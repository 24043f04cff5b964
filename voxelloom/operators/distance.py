"""Euclidean distance to the nearest voxel outside a mask."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import BLOCK, gather, inner_origin, map_blocks
from voxelloom.operators.envelope import nearest_site
from voxelloom.operators.joins import join_small
from voxelloom.operators.labels import offsets
from voxelloom.operators.morphology import BOX, _inside, shifted, volume_boxes
from voxelloom.session import cut

VOXEL = ["volume_id", "z", "y", "x"]


def _windowed_squares(outside: np.ndarray, radius, spacing) -> np.ndarray:
    """Separable squared distance to ``outside`` within a window per axis."""
    out = np.where(outside, 0.0, np.inf)
    for axis in range(3):
        best = out.copy()
        for k in range(1, radius[axis] + 1):
            cost = (k * spacing[axis]) ** 2
            for sign in (k, -k):
                moved = np.full_like(out, np.inf)
                dst = [slice(None)] * 3
                src = [slice(None)] * 3
                dst[axis] = slice(max(0, -sign), out.shape[axis] - max(0, sign))
                src[axis] = slice(max(0, sign), out.shape[axis] - max(0, -sign))
                moved[tuple(dst)] = out[tuple(src)]
                np.minimum(best, moved + cost, out=best)
        out = best
    return out


def distance(mask: DataFrame, volumes: DataFrame, radius: int = 8, spacing=(1.0, 1.0, 1.0), block=BLOCK) -> DataFrame:
    """``volume_id, z, y, x, dist`` for mask voxels.

    A window of ``radius`` voxels answers most of them inside one block pass.
    Only a hit no farther than the window's smallest physical half-width is
    final; the others are settled by lower envelopes over the outside voxels
    that touch the mask, among which the nearest always is.
    """
    reach = (radius,) * 3
    sure = radius * min(spacing)

    def kernel(arrays, origin, inner, meta):
        m = arrays["_on"]
        outside = ~m & _inside(m.shape, origin, meta, BOX[::2], BOX[1::2])
        d = np.sqrt(_windowed_squares(outside, reach, spacing)[inner])
        d = np.where(d <= sure, d, np.nan)
        return gather(m[inner], inner_origin(origin, inner), dist=d)

    rows = join_small(mask.select(*VOXEL, F.lit(True).alias("_on")), volume_boxes(volumes), ["volume_id"], materialise=False)
    near = map_blocks(rows, kernel, "z long, y long, x long, dist double", {"_on": (np.bool_, False)}, block,
                      lo=reach, hi=reach, meta=BOX, core_only=True, inside=True)
    near = near.withColumn("dist", F.when(F.isnan("dist"), None).otherwise(F.col("dist")))
    near = cut(near)
    far = near.where(F.col("dist").isNull())
    if far.isEmpty():
        return near
    rim = _outer_rim(mask, volumes, block)
    found = nearest_site(far, rim, spacing)
    return near.where(F.col("dist").isNotNull()).unionByName(found.select(*VOXEL, "dist"))


def _outer_rim(mask: DataFrame, volumes: DataFrame, block) -> DataFrame:
    """Voxels outside the mask, inside the volume, that touch a mask voxel by a face."""

    def kernel(arrays, origin, inner, meta):
        m = arrays["_on"]
        touch = np.zeros_like(m)
        for off in offsets(6):
            touch |= shifted(m, off)
        return gather((touch & ~m & _inside(m.shape, origin, meta, BOX[::2], BOX[1::2]))[inner], inner_origin(origin, inner))

    rows = join_small(mask.select(*VOXEL, F.lit(True).alias("_on")), volume_boxes(volumes), ["volume_id"], materialise=False)
    return map_blocks(rows, kernel, "z long, y long, x long", {"_on": (np.bool_, False)}, block,
                      lo=(1, 1, 1), hi=(1, 1, 1), meta=BOX, inside=True)


def grow_labels(seeds: DataFrame, mask: DataFrame) -> DataFrame:
    """Every mask voxel takes the label of its nearest seed (smallest label on ties)."""
    found = nearest_site(mask.select(*VOXEL), seeds.select(*VOXEL, "label"))
    return found.where(F.col("label").isNotNull()).select(*VOXEL, "label")


def height_map(vox: DataFrame, dist: DataFrame, fg: str, bd: str, penalty: float | None = 2.0,
               bd_threshold: float = 0.25, barrier_fg_threshold: float | None = None) -> DataFrame:
    """``(dmax - d) / dmax`` on every row of ``vox``, with barrier voxels raised.

    Barrier voxels (boundary above, foreground below its threshold) get the
    constant ``penalty``, or the volume's largest height plus boundary when
    ``penalty`` is None.  ``barrier_fg_threshold`` defaults to the boundary
    threshold.  Voxels outside the distance mask have distance 0.
    """
    low_fg = bd_threshold if barrier_fg_threshold is None else barrier_fg_threshold
    d = vox.join(dist.select(*VOXEL, "dist"), VOXEL, "left").withColumn("dist", F.coalesce("dist", F.lit(0.0)))
    top = dist.groupBy("volume_id").agg(F.max("dist").alias("_dmax"))
    h = F.when(F.col("_dmax") > 0, (F.col("_dmax") - F.col("dist")) / F.col("_dmax")).otherwise(F.lit(0.0))
    out = join_small(d, top, ["volume_id"], "left").withColumn("height", h).drop("_dmax")
    wall = (F.col(bd) > bd_threshold) & (F.col(fg) < low_fg)
    if penalty is not None:
        return out.withColumn("height", F.when(wall, F.lit(float(penalty))).otherwise(F.col("height")))
    peak = out.groupBy("volume_id").agg(F.max(F.col("height") + F.col(bd)).alias("_peak"))
    return join_small(out, peak, ["volume_id"]).withColumn(
        "height", F.when(wall, F.col("_peak")).otherwise(F.col("height"))).drop("_peak")
