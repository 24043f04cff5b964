"""Projections, filters and label mapping on voxel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.joins import join_small
from voxelloom.operators.ordered import dense_index, exact_quantiles
from voxelloom.session import cut

VOXEL = ["volume_id", "z", "y", "x"]
EPS = 1e-7  # fixed value: part of the normalisation formulas


def binarise(vox: DataFrame, condition: Column, out: str = "mask") -> DataFrame:
    return vox.withColumn(out, condition)


def keep_ids(labels: DataFrame, ids: list[int], fallback: DataFrame | None = None) -> DataFrame:
    """Voxels whose label is in ``ids``; volumes without any take every
    non-zero voxel of ``fallback``."""
    kept = labels.where(F.col("label").isin(ids))
    if fallback is None:
        return kept
    served = kept.select("volume_id").distinct()
    spare = join_small(fallback.where(F.col("label") != 0), served, ["volume_id"], "left_anti")
    return kept.select(*VOXEL).unionByName(spare.select(*VOXEL))


def group_remap(vox: DataFrame, groups: DataFrame, label: str = "label") -> DataFrame:
    """Class id of the last group that lists the label; 0 outside all groups.

    ``groups`` is the given parameter table ``group_id, label``.
    """
    last = groups.groupBy("label").agg(F.max("group_id").alias("group_id")).withColumnRenamed("label", label)
    return join_small(vox, last, [label], "left").withColumn("group_id", F.coalesce("group_id", F.lit(0)))


def group_channels(vox: DataFrame, groups: DataFrame, label: str = "label") -> DataFrame:
    """One row per voxel and group; a voxel may be in several groups."""
    return join_small(vox, groups.withColumnRenamed("label", label), [label])


def apply_mapping(vox: DataFrame, mapping: DataFrame, instance: str, cls: str) -> DataFrame:
    """``mapping``: volume_id, instance, class.  Unmapped instances become 0."""
    return join_small(vox, mapping, ["volume_id", instance], "left").withColumn(cls, F.coalesce(cls, F.lit(0)))


def sequential(labels: DataFrame) -> DataFrame:
    return dense_index(labels, ["volume_id"], "label", "new_label")


def is_binary(labels: DataFrame) -> DataFrame:
    return labels.groupBy("volume_id").agg((F.max("label") <= 1).alias("is_binary"))


def union_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).union(b.select(*VOXEL)).distinct()


def crop(vox: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Half-open box per axis; coordinates restart at the corner."""
    out = vox
    for a, (lo, hi) in box.items():
        out = out.where((F.col(a) >= lo) & (F.col(a) < hi)).withColumn(a, F.col(a) - lo)
    return out


def crop_to_shape(vox: DataFrame, volumes: DataFrame, shape, centred: bool) -> DataFrame:
    out = join_small(vox, volumes, ["volume_id"])
    for a, size in zip(("z", "y", "x"), shape):
        slack = F.greatest(F.lit(0), F.col(f"n{a}") - size)
        start = F.floor(slack / 2) if centred else F.lit(0).cast("long")
        out = out.withColumn("_s", start)
        out = out.where((F.col(a) >= F.col("_s")) & (F.col(a) < F.col("_s") + size)).withColumn(a, F.col(a) - F.col("_s"))
    return out.select(*vox.columns)


def centre_slices(vox: DataFrame, volumes: DataFrame, fraction: float) -> DataFrame:
    """At least one slice around the middle of z."""
    count = F.greatest(F.lit(1), F.floor(F.col("nz") * fraction))
    first = F.greatest(F.lit(0), F.floor(F.col("nz") / 2) - F.floor(count / 2))
    window = volumes.select("volume_id", first.alias("_a"), F.least(first + count, F.col("nz")).alias("_b"))
    return join_small(vox, window, ["volume_id"]).where((F.col("z") >= F.col("_a")) & (F.col("z") < F.col("_b"))).select(*vox.columns)


def drop_empty_slices(vox: DataFrame, labelled: Column) -> DataFrame:
    """Slices without any labelled voxel go; z is renumbered from 0."""
    used = vox.where(labelled).select("volume_id", "z").distinct()
    kept = join_small(vox, used, ["volume_id", "z"], "left_semi")
    return dense_index(kept, ["volume_id"], "z", "_z").withColumn("z", F.col("_z") - 1).select(*vox.columns)


def flip(vox: DataFrame, volumes: DataFrame, axis: str) -> DataFrame:
    n = volumes.select("volume_id", F.col(f"n{axis}").alias("_n"))
    return join_small(vox, n, ["volume_id"]).withColumn(axis, F.col("_n") - 1 - F.col(axis)).select(*vox.columns)


def signed_to_unsigned(value: Column) -> Column:
    return value + 128


def normalise_percentile(vox: DataFrame, value: str, lower: float, upper: float, clip: bool = True) -> DataFrame:
    """Per-volume percentile scaling; the quantiles come from a value histogram."""
    q = exact_quantiles(vox, ["volume_id"], value, [lower, upper], ["_lo", "_hi"])
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS)
    if clip:
        scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    return join_small(vox, q, ["volume_id"]).withColumn("scaled", scaled).drop("_lo", "_hi")


def standardise(vox: DataFrame, value: str) -> DataFrame:
    stats = vox.groupBy("volume_id").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return join_small(vox, stats, ["volume_id"]).withColumn(
        "scaled", (F.col(value) - F.col("_m")) / (F.col("_s") + EPS)).drop("_m", "_s")


def state_masks(state: Column) -> tuple[Column, Column]:
    """Loss mask and evaluation-ignore mask of the state channel."""
    return F.abs(state - 2) >= 0.5, state != 1


def coarse_lookup(fine: DataFrame, coarse: DataFrame, coarse_shape: DataFrame, scale, column: str) -> DataFrame:
    """Value of the coarse voxel under each fine voxel, clipped at the edge."""
    out = join_small(fine, coarse_shape, ["volume_id"])
    for a, s in zip(("z", "y", "x"), scale):
        out = out.withColumn(f"_{a}", F.least(F.floor(F.col(a) / s), F.col(f"n{a}") - 1))
    grid = coarse.select("volume_id", *[F.col(a).alias(f"_{a}") for a in ("z", "y", "x")], column)
    return out.join(grid, ["volume_id", "_z", "_y", "_x"], "left").select(*fine.columns, F.coalesce(column, F.lit(0)).alias(column))


def overlaps(pairs: DataFrame, a: str, b: str, keys=("volume_id",)) -> DataFrame:
    """Foreground pairs with sizes and IoU, from one contingency pass."""
    return overlaps_of(cut(pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))), a, b, keys)


def overlaps_of(counts: DataFrame, a: str, b: str, keys=("volume_id",)) -> DataFrame:
    """The same from a contingency table (keys, a, b, n)."""
    size_a = counts.where(F.col(a) > 0).groupBy(*keys, a).agg(F.sum("n").alias("n_a"))
    size_b = counts.where(F.col(b) > 0).groupBy(*keys, b).agg(F.sum("n").alias("n_b"))
    keys = list(keys)
    return (
        counts.where((F.col(a) > 0) & (F.col(b) > 0)).join(size_a, keys + [a]).join(size_b, keys + [b])
        .withColumn("iou", F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))))


# Offsets of the 6-, 18- and 26-neighbourhood.
def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    steps = (-1, 0, 1)
    return [(z, y, x) for z in steps for y in steps for x in steps if 0 < abs(z) + abs(y) + abs(x) <= reach]


def neighbour_pairs(labels: DataFrame, connectivity: int = 6) -> DataFrame:
    """Each voxel with the label of every labelled neighbour, as an equi-join."""
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("dz", "dy", "dx"))])
                               for o in offsets(connectivity)]))
    moved = labels.select(*VOXEL, "label", step.alias("_o")).select(
        "volume_id", F.col("z").alias("_z"), F.col("y").alias("_y"), F.col("x").alias("_x"), "label",
        *[(F.col(a) + F.col(f"_o.d{a}")).alias(a) for a in ("z", "y", "x")])
    other = labels.select(*VOXEL, F.col("label").alias("neighbour"))
    return moved.join(other, VOXEL)
