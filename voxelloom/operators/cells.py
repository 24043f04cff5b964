"""Cell-level roll-ups of the object table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.shape import log10_shifted, ratio
from voxelloom.operators.ordered import medians

CELL = ["volume_id", "cell_id"]


def cell_table(cells: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per cell; cells without objects keep count 0 and NULL mean.

    ``cells`` has ``volume_id, cell_id, cell_volume_um3``.
    """
    agg = objects.where(F.col("cell_id").isNotNull()).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("volume_um3").alias("_v"), F.avg("volume_um3").alias("_m"))
    vol = F.col("cell_volume_um3")
    n, v = F.coalesce("_n", F.lit(0)), F.coalesce("_v", F.lit(0.0))
    return cells.join(agg, CELL, "left").select(
        *cells.columns, n.alias("mito_count"), v.alias("mito_volume_um3"),
        F.when(vol > 0, v / vol).alias("mito_volume_fraction"), F.col("_m").alias("mito_mean_volume_um3"),
        F.when(vol > 0, n / vol).alias("mito_density_per_um3"))


def cell_summary_2d(vox: DataFrame, cell: str, obj: str, keys=("volume_id",)) -> DataFrame:
    """Area, object area, object ratio and distinct object count per cell."""
    return vox.where(F.col(cell) > 0).groupBy(*keys, cell).agg(
        F.count(F.lit(1)).alias("cell_area"),
        F.count(F.when(F.col(obj) > 0, 1)).alias("object_area"),
        F.count_distinct(F.when(F.col(obj) > 0, F.col(obj))).alias("object_count"),
    ).withColumn("object_ratio", F.col("object_area") / F.col("cell_area"))


def qc_objects(objects: DataFrame, exclude_border: bool = True, min_intensity: float = 1.0,
               max_elongation: float = 20.0) -> DataFrame:
    """Keep plausible objects; each rule applies only if its column exists.

    A missing elongation fails the rule, as a comparison with NaN does.
    """
    rules = []
    if exclude_border and "touches_border" in objects.columns:
        rules.append(~F.col("touches_border"))
    if "mean_intensity" in objects.columns:
        rules.append(F.col("mean_intensity") >= min_intensity)
    if "elongation_a_over_c" in objects.columns:
        rules.append(F.col("elongation_a_over_c") < max_elongation)
    return objects.where(reduce(lambda a, b: a & b, rules)) if rules else objects


def qc_cells(cells: DataFrame, objects: DataFrame, max_fraction: float = 1.0) -> DataFrame:
    """Cell counts recomputed from clean objects; empty or overfull cells go."""
    base = cells.select("volume_id", "cell_id", "cell_volume_um3")
    fresh = cell_table(base, objects).select(
        "volume_id", "cell_id", "cell_volume_um3", "mito_count", "mito_volume_um3", "mito_volume_fraction")
    return fresh.where((F.col("mito_count") > 0) & (F.col("mito_volume_fraction") <= max_fraction))


def objects_in_cells(objects: DataFrame, cells: DataFrame) -> DataFrame:
    """Inner merge of the surviving cells' volume onto their objects."""
    out = objects.join(cells.select(*CELL, "cell_volume_um3"), CELL)
    return out.withColumnRenamed("volume_um3", "mito_volume_um3").withColumn(
        "mito_volume_fraction_of_cell", ratio(F.col("mito_volume_um3"), F.col("cell_volume_um3")))


# measure, output stem, statistics
_MEASURES = [
    ("mito_volume_um3", "mito_volume_um3", ("mean", "median", "std")),
    ("mito_volume_fraction_of_cell", "single_mito_fraction_of_cell", ("mean",)),
    ("sphericity", "mito_sphericity", ("mean", "median")),
    ("sv_ratio", "mito_sv_ratio", ("mean", "median")),
    ("elongation_a_over_c", "mito_elongation", ("mean", "median")),
    ("flatness_b_over_c", "mito_flatness", ("mean", "median")),
]
_LOGGED = ["cell_volume_um3", "mito_count", "mito_count_density", "mito_volume_um3", "mito_volume_density",
           "mean_mito_volume_um3", "median_mito_volume_um3"]


def cell_level_summary(merged: DataFrame, cells: DataFrame) -> DataFrame:
    """Densities, per-cell statistics of whichever measures exist, and logs."""
    aggs, meds = [], {}
    for col, stem, stats in _MEASURES:
        if col not in merged.columns:
            continue
        aggs.append(F.avg(col).alias(f"mean_{stem}"))
        if "std" in stats:
            aggs.append(F.stddev_samp(col).alias(f"std_{stem}"))
        if "median" in stats:
            meds[col] = f"median_{stem}"
    vol = F.col("cell_volume_um3")
    keep = [c for c in ("mito_volume_um3", "mito_volume_fraction", "mito_surface_um2") if c in cells.columns]
    out = cells.select(*CELL, "cell_volume_um3", "mito_count", *keep,
                       ratio(F.col("mito_count"), vol).alias("mito_count_density"))
    if "mito_volume_um3" in keep:
        out = out.withColumn("mito_volume_density", ratio(F.col("mito_volume_um3"), vol))
    if "mito_surface_um2" in keep:
        out = out.withColumn("mito_surface_density", ratio(F.col("mito_surface_um2"), vol))
    if aggs:
        out = out.join(merged.groupBy(*CELL).agg(*aggs), CELL)
    if meds:
        out = out.join(medians(merged, CELL, meds), CELL, "left")
    return out.select("*", *[log10_shifted(F.col(c)).alias(f"log10_{c}") for c in _LOGGED if c in out.columns])


def normalised_objects(objects: DataFrame, cells: DataFrame) -> DataFrame:
    """Objects with their size relative to the cell, and the cell's volume density."""
    total = objects.groupBy(*CELL).agg(F.sum("volume_um3").alias("_total"))
    joined = objects.where(F.col("cell_id").isNotNull()).join(
        cells.select(*CELL, "cell_volume_um3"), CELL).join(total, CELL)
    vol = F.col("cell_volume_um3")
    return joined.select(
        *objects.columns, vol, (F.col("volume_um3") / vol).alias("mito_size_norm"),
        (F.col("_total") / vol).alias("mito_volume_density"))


def normalised_summary(objects: DataFrame, cells: DataFrame) -> DataFrame:
    """Cell means of the normalised object measures (older summary)."""
    full = cell_table(cells, objects)
    merged = normalised_objects(objects, full.where(F.col("mito_count") > 0))
    means = {"sphericity": "mean_mito_sphericity", "sv_ratio": "mean_mito_sv_ratio",
             "elongation_a_over_c": "mean_mito_elongation", "flatness_b_over_c": "mean_mito_flatness"}
    agg = merged.groupBy(*CELL).agg(
        F.count("label_id").alias("num_mitos_annotated"), F.avg("volume_um3").alias("mean_mito_volume_um3"),
        F.stddev_samp("volume_um3").alias("std_mito_volume_um3"), F.avg("mito_size_norm").alias("mean_mito_size_norm"),
        *[F.avg(c).alias(n) for c, n in means.items() if c in merged.columns])
    med = medians(merged, CELL, {"volume_um3": "median_mito_volume_um3"})
    head = full.where(F.col("mito_count") > 0).select(
        *CELL, "cell_volume_um3", "mito_count", "mito_volume_um3", "mito_volume_fraction")
    return head.join(agg, CELL).join(med, CELL, "left")
