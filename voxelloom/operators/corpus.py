"""File- and corpus-level aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import BLOCK
from voxelloom.operators.components import component_sizes, components
from voxelloom.operators.edit import with_inner
from voxelloom.operators.ordered import exact_quantiles, medians

FILE = "volume_id"


def _total(volumes: DataFrame) -> DataFrame:
    return volumes.select(FILE, (F.col("nz") * F.col("ny") * F.col("nx")).alias("total_voxels"))


def instance_stats(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """One row per volume, also for volumes without objects."""
    sizes = labels.groupBy(FILE, "label").agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("n_instances"), F.sum("n").alias("total_fg_voxels"), F.round(F.avg("n"), 1).alias("vol_mean"),
        F.round(F.stddev_pop("n"), 1).alias("vol_std"), F.min("n").alias("vol_min"), F.max("n").alias("vol_max"))
    med = exact_quantiles(sizes, [FILE], "n", [0.5], ["_m"])
    out = _total(volumes).join(stats, FILE, "left").join(med, FILE, "left")
    return out.select(
        FILE, F.coalesce("n_instances", F.lit(0)).alias("n_instances"), F.coalesce("total_fg_voxels", F.lit(0)).alias("total_fg_voxels"),
        "total_voxels", F.round(F.coalesce("total_fg_voxels", F.lit(0)) / F.col("total_voxels"), 4).alias("fg_fraction"),
        "vol_mean", F.round("_m", 1).alias("vol_median"), "vol_std", "vol_min", "vol_max")


def summary_row(stats: DataFrame) -> DataFrame:
    """Pooled row over files; none unless there are at least two files."""
    med = exact_quantiles(stats, [], "vol_median", [0.5], ["_m"]).withColumn("_j", F.lit(1))
    agg = stats.agg(
        F.count(F.lit(1)).alias("_n"), F.sum("n_instances").alias("n_instances"), F.sum("total_fg_voxels").alias("total_fg_voxels"),
        F.sum("total_voxels").alias("total_voxels"), F.round(F.avg("vol_mean"), 1).alias("vol_mean"),
        F.round(F.avg("vol_std"), 1).alias("vol_std"), F.min("vol_min").alias("vol_min"), F.max("vol_max").alias("vol_max"))
    out = agg.withColumn("_j", F.lit(1)).join(med, "_j", "left").where("_n > 1")
    return out.select(
        F.format_string("SUMMARY (%d files)", "_n").alias("file"), "n_instances", "total_fg_voxels", "total_voxels",
        F.round(F.col("total_fg_voxels") / F.col("total_voxels"), 4).alias("fg_fraction"), "vol_mean",
        F.round("_m", 1).alias("vol_median"), "vol_std", "vol_min", "vol_max")


def counts_with_total(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Objects per file plus a total and a mean row."""
    per = volumes.select(FILE).join(
        labels.groupBy(FILE).agg(F.count_distinct("label").alias("n")), FILE, "left").select(
        F.col(FILE).cast("string").alias("file"), F.coalesce("n", F.lit(0)).cast("double").alias("objects"))
    total = per.agg(F.sum("objects").alias("t"), F.avg("objects").alias("m"))
    extra = total.select(F.inline(F.array(
        F.struct(F.lit("__TOTAL_ALL_FILES__").alias("file"), F.col("t").alias("objects")),
        F.struct(F.lit("__MEAN_PER_FILE__").alias("file"), F.col("m").alias("objects")))))
    return per.unionByName(extra)


def inner_counts(mask: DataFrame, inner: DataFrame, volumes: DataFrame, connectivity: int = 6, block=BLOCK) -> tuple[DataFrame, DataFrame]:
    """Per file: objects, objects with inner voxels, inner components and mean
    sizes; and one corpus row of totals, means and population deviations."""
    one = F.lit(1).cast("long").alias("label")
    objs = components(mask.select(FILE, "z", "y", "x", one), connectivity, False, block)
    objs = objs.select(FILE, "z", "y", "x", F.col("component").alias("label"))
    parts = components(inner.select(FILE, "z", "y", "x", one), connectivity, False, block)
    flags = with_inner(objs, inner)
    size = objs.groupBy(FILE, "label").agg(F.count(F.lit(1)).alias("n")).join(flags, [FILE, "label"])
    isize = component_sizes(parts)
    good = F.when(F.col("has_inner"), F.col("n"))
    a = size.groupBy(FILE).agg(F.count(F.lit(1)).alias("objects"), F.count(good).alias("objects_with_inner"), F.avg(good).alias("mean_object_size"))
    b = isize.groupBy(FILE).agg(F.count(F.lit(1)).alias("inner_objects"), F.avg("size").alias("mean_inner_size"))
    per = volumes.select(FILE).join(a, FILE, "left").join(b, FILE, "left").select(
        FILE, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("objects", "objects_with_inner", "inner_objects")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_object_size", "mean_inner_size")])
    tot = [f.withColumn("_j", F.lit(1)) for f in (
        per.agg(F.count(F.lit(1)).alias("files"), F.sum("objects").alias("objects"), F.sum("objects_with_inner").alias("objects_with_inner"),
                F.sum("inner_objects").alias("inner_objects")),
        size.agg(F.coalesce(F.avg(good), F.lit(0.0)).alias("mean_object_size"), F.coalesce(F.stddev_pop(good), F.lit(0.0)).alias("std_object_size")),
        isize.agg(F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_inner_size"), F.coalesce(F.stddev_pop("size"), F.lit(0.0)).alias("std_inner_size")))]
    return per, tot[0].join(tot[1], "_j").join(tot[2], "_j").drop("_j")


def component_size_stats(labels: DataFrame, ids: list[int], volumes: DataFrame, connectivity: int = 6, block=BLOCK) -> DataFrame:
    """Sizes of the connected parts of the selected ids; NULLs without any."""
    mask = labels.where(F.col("label").isin(ids)).select(FILE, "z", "y", "x", F.lit(1).cast("long").alias("label"))
    sizes = component_sizes(components(mask, connectivity, False, block))
    agg = sizes.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("smallest"), F.max("size").alias("biggest"),
        F.avg("size").alias("mean"), F.stddev_pop("size").alias("std"))
    med = medians(sizes, [FILE], {"size": "median"})
    return volumes.select(FILE).join(agg, FILE, "left").join(med, FILE, "left").select(
        FILE, F.coalesce("n", F.lit(0)).alias("amount_instances"), "smallest", "biggest", "mean", "std", "median")


def group_presence(labels: DataFrame, groups: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per group: files with it, mean number of its ids, mean share of the volume."""
    ids = labels.groupBy(FILE, "label").agg(F.count(F.lit(1)).alias("n"))
    per = ids.join(groups, "label").groupBy(FILE, "group_id").agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("n"))
    share = per.join(_total(volumes), FILE).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.avg("ids").alias("mean_instances"), F.avg(F.col("n") / F.col("total_voxels")).alias("mean_proportion"))
    return groups.select("group_id").distinct().join(share, "group_id", "left").select(
        "group_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files",)],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_instances", "mean_proportion")])


def present_groups(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups found in each file with their ids, which a group bounds in number."""
    found = labels.select(FILE, "label").distinct().join(groups, "label")
    return found.groupBy(FILE, "group_id").agg(F.array_sort(F.collect_list("label")).alias("ids"))


def files_with_groups(labels: DataFrame, groups: DataFrame, volumes: DataFrame, min_groups: int = 1, min_slices: float = 0.0) -> DataFrame:
    """Files with enough groups, or with some group in more than a share of slices."""
    per = labels.join(groups, "label").groupBy(FILE, "group_id").agg(F.count_distinct("z").alias("slices"))
    per = per.join(volumes.select(FILE, "nz"), FILE).where(F.col("slices") / F.col("nz") > min_slices)
    return per.groupBy(FILE).agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") >= min_groups)


def varied_files(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Files whose label volume is not constant; background is implied."""
    ids = labels.groupBy(FILE).agg(F.count_distinct("label").alias("_k"), F.count(F.lit(1)).alias("_n"))
    return ids.join(_total(volumes), FILE).where(
        (F.col("_k") + (F.col("_n") < F.col("total_voxels")).cast("int")) > 1).select(FILE)


def axis_statistics(volumes: DataFrame, axes: list[str]) -> DataFrame:
    """min, max, mean, median per axis in long form."""
    long = volumes.select(*[F.col(a).cast("double").alias(a) for a in axes]).unpivot([], axes, "axis", "value")
    base = long.groupBy("axis").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return base.join(exact_quantiles(long, ["axis"], "value", [0.5], ["median"]), "axis")


def prevalence(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *columns)


def inconsistent_share(catalog: DataFrame, file: str, shape: Column) -> DataFrame:
    """Percentage of files whose datasets differ in shape."""
    per = catalog.groupBy(file).agg((F.count_distinct(shape) > 1).cast("double").alias("_b"))
    return per.agg(F.count(F.lit(1)).alias("n_files"), F.sum("_b").cast("long").alias("n_inconsistent"), (100 * F.avg("_b")).alias("percent"))


def intensity_metadata(vox: DataFrame, value: str, label: str) -> DataFrame:
    return vox.groupBy(FILE).agg(
        (F.max("z") + 1).alias("nz"), (F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"),
        (F.max(label) > 0).alias("has_label"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def corpus_average(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count(F.lit(1)).alias("n_files"), *[F.avg(c).alias(f"avg_{c}") for c in ("nz", "ny", "nx", "min", "max", "mean", "std")],
                    F.count(F.when(F.col("has_label"), 1)).alias("n_labelled"))


def state_composition(vox: DataFrame, state: str, inner: Column) -> DataFrame:
    """State counts per file and over all files (``volume_id`` NULL)."""
    def n(c):
        return F.count(F.when(c, 1))
    s = F.col(state)
    out = vox.rollup(FILE).agg(n(s == 0).alias("n_bg"), n(s == 1).alias("n_annotated"), n(s == 2).alias("n_unannotated"), n(inner).alias("n_inner"))
    return out.withColumn("inner_pct", F.when(F.col("n_annotated") > 0, 100 * F.col("n_inner") / F.col("n_annotated")))


def duplicate_files(files: DataFrame, name: str, content_hash: str, path: str) -> DataFrame:
    """Rows of files that share name and hash with another file.

    Counting is a partial aggregation and one row per duplicated key joins
    back, so a key with very many copies is never gathered in one place.
    """
    often = files.groupBy(name, content_hash).agg(F.count(F.lit(1)).alias("copies"), F.min(path).alias("original")).where("copies > 1")
    return files.select(name, content_hash, path).join(often, [name, content_hash])


def audit(files: DataFrame, catalog: DataFrame, key: str, constant_slices: DataFrame) -> DataFrame:
    """Files lacking a dataset and files with constant slices."""
    missing = files.join(catalog.where(F.col("key") == key), FILE, "left_anti").select(FILE, F.lit("missing dataset").alias("issue"))
    return missing.unionByName(constant_slices.select(FILE, F.lit("constant slice").alias("issue")).distinct())


def constant_slices(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Slices holding one single value, background included."""
    every = volumes.select(FILE, (F.col("ny") * F.col("nx")).alias("_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nz") - 1)).alias("z"))
    per = labels.groupBy(FILE, "z").agg(F.count_distinct("label").alias("_k"), F.count(F.lit(1)).alias("_n"))
    out = every.join(per, [FILE, "z"], "left")
    return out.where(F.col("_k").isNull() | ((F.col("_k") == 1) & (F.col("_n") == F.col("_a")))).select(FILE, "z")
