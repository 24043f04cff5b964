"""Per-object measurements: grouped aggregates over voxel rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.shape import ratio, sphericity, with_eigenvalues
from voxelloom.operators.blocks import BLOCK, map_blocks
from voxelloom.operators.lattice import config_table, cube_histogram, square_histogram, square_table
from voxelloom.operators.nearest import nearest
from voxelloom.session import cut

OBJECT = ["volume_id", "label"]
AXES = ("z", "y", "x")


def voxel_count(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*OBJECT).agg(F.count(F.lit(1)).alias("volume_vx"))


def bounding_box(labels: DataFrame, keys=OBJECT) -> DataFrame:
    """Inclusive corners ``z0..x1``."""
    aggs = [f(a).alias(f"{a}{i}") for a in AXES for i, f in ((0, F.min), (1, F.max))]
    return labels.groupBy(*keys).agg(*aggs)


def padded_box(boxes: DataFrame, volumes: DataFrame, margin: int) -> DataFrame:
    """Stop-exclusive boxes grown by ``margin`` and clipped to the volume."""
    out = boxes.join(volumes, "volume_id")
    for a in AXES:
        out = out.withColumn(f"{a}0", F.greatest(F.lit(0), F.col(f"{a}0") - margin))
        out = out.withColumn(f"{a}1", F.least(F.col(f"n{a}"), F.col(f"{a}1") + margin + 1))
    return out.select(*boxes.columns)


def box_corners(boxes: DataFrame) -> DataFrame:
    """The eight corners of each box, one row each."""
    corners = F.array(*[
        F.struct(F.lit(4 * i + 2 * j + k).cast("long").alias("corner"), F.col(f"z{i}").alias("z"),
                 F.col(f"y{j}").alias("y"), F.col(f"x{k}").alias("x"))
        for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    keep = [c for c in boxes.columns if c not in {f"{a}{i}" for a in AXES for i in (0, 1)}]
    return boxes.select(*keep, F.inline(corners))


def centroid(labels: DataFrame, size) -> DataFrame:
    means = labels.groupBy(*OBJECT).agg(*[F.avg(a).alias(f"centroid_{a}_vx") for a in AXES])
    return means.select("*", *[(F.col(f"centroid_{a}_vx") * s).alias(f"centroid_{a}_um") for a, s in zip(AXES, size)])


def _cube(size) -> float:
    return size[0] * size[1] * size[2]


def intensity(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*OBJECT).agg(*_intensity_aggs())


def _intensity_aggs() -> list[Column]:
    return [F.avg("raw").alias("mean_intensity"), F.min("raw").alias("min_intensity"),
            F.max("raw").alias("max_intensity"), F.stddev_pop("raw").alias("std_intensity")]


_PAIRS = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]


def _moment_aggs(size) -> list[Column]:
    s = dict(zip(AXES, size))
    return [F.covar_samp(F.col(a) * s[a], F.col(b) * s[b]).alias(f"_m{a}{b}") for a, b in _PAIRS]


def _axes_from_moments(df: DataFrame) -> DataFrame:
    df = with_eigenvalues(df, *[f"_m{a}{b}" for a, b in _PAIRS])
    for name, value in zip(("a_um", "b_um", "c_um"), ("_l1", "_l2", "_l3")):
        # rounding noise of a flat object must not turn into a tiny axis
        size = F.when(F.col(value) > 1e-15, F.col(value)).otherwise(F.lit(0.0))
        df = df.withColumn(name, F.when(F.col("_mzz").isNotNull(), F.sqrt(size)))
    a, b, c = F.col("a_um"), F.col("b_um"), F.col("c_um")
    return df.select(
        "*", ratio(a, c).alias("elongation_a_over_c"), ratio(b, c).alias("flatness_b_over_c"),
        F.when(c != 0, ratio(c, a)).alias("isotropy_c_over_a"),
    ).drop("_l1", "_l2", "_l3", *[f"_m{x}{y}" for x, y in _PAIRS])


def principal_axes(labels: DataFrame, size) -> DataFrame:
    """Semi-axes a >= b >= c; NULL for a single voxel, ratios NULL if c is 0."""
    return _axes_from_moments(labels.groupBy(*OBJECT).agg(*_moment_aggs(size)))


def _dot(name: str) -> Column:
    return F.sum(F.col("n") * F.col(name))


def lattice_measures(labels: DataFrame, volumes: DataFrame, size=(1.0, 1.0, 1.0), block=None) -> DataFrame:
    """Euler number, exposed face count/area and iso-surface area per object."""
    args = (block,) if block else ()
    hist = cube_histogram(labels, volumes, *args)
    table = F.broadcast(config_table(labels.sparkSession, size))
    areas = {"z": size[1] * size[2], "y": size[0] * size[2], "x": size[0] * size[1]}
    faces = {a: _dot(f"face_{a}") / 4 for a in AXES}
    return hist.join(table, "config").groupBy(*OBJECT).agg(
        (_dot("euler8") / 8).cast("long").alias("euler_char"),
        sum((faces[a] for a in AXES), F.lit(0)).cast("long").alias("exposed_faces"),
        sum((faces[a] * areas[a] for a in AXES), F.lit(0.0)).alias("exposed_area_um2"),
        F.sum(F.when(F.col("inside"), F.col("n") * F.col("iso"))).alias("_iso"),
    ).withColumn("surface_um2", F.when(F.col("_iso") > 0, F.col("_iso"))).drop("_iso")


def _at_border() -> Column:
    hits = [F.col(f"{a}0") == 0 for a in AXES] + [F.col(f"{a}1") == F.col(f"n{a}") - 1 for a in AXES]
    return reduce(lambda p, q: p | q, hits)


def touches_border(boxes: DataFrame, volumes: DataFrame) -> DataFrame:
    return boxes.join(volumes, "volume_id").select(*OBJECT, _at_border().alias("touches_border"))


def faces_touched(boxes: DataFrame, volumes: DataFrame, disregard_z: bool = False) -> DataFrame:
    df = boxes.join(volumes, "volume_id")
    axes = AXES[1:] if disregard_z else AXES
    hits = [(F.col(f"{a}0") == 0).cast("long") for a in axes]
    hits += [(F.col(f"{a}1") == F.col(f"n{a}") - 1).cast("long") for a in axes]
    return df.select(*OBJECT, sum(hits[1:], hits[0]).alias("faces_touched"))


def contingency(pairs: DataFrame, a: str, b: str, keys=("volume_id",)) -> DataFrame:
    """Co-occurrence counts of two label columns held on the same voxel rows."""
    return pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))


def majority(counts: DataFrame, keys: list[str], candidate: str, out: str) -> DataFrame:
    """Candidate with the largest ``n`` per key, smallest id on ties."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(candidate).alias("id"))).alias("_b")
    return counts.groupBy(*keys).agg(best).select(
        *keys, F.col("_b.id").alias(out), (-F.col("_b.n")).alias("overlap"))


def assign_cell(labels: DataFrame) -> DataFrame:
    """Cell with most overlap per object; NULL when no voxel lies in a cell."""
    counts = contingency(labels, "label", "cell")
    best = F.min(F.when(F.col("cell") != 0, F.struct((-F.col("n")).alias("n"), F.col("cell").alias("id"))))
    return counts.groupBy(*OBJECT).agg(best.alias("_b")).select(*OBJECT, F.col("_b.id").alias("cell_id"))


def majority_class(pairs: DataFrame, instance: str, cls: str, min_frac: float) -> DataFrame:
    """Majority non-zero class of an instance, dropped below ``min_frac`` of its size."""
    counts = contingency(pairs, instance, cls)
    best = F.min(F.when(F.col(cls) != 0, F.struct((-F.col("n")).alias("n"), F.col(cls).alias("id"))))
    return (
        counts.groupBy("volume_id", instance).agg(best.alias("_b"), F.sum("n").alias("size"))
        .where(-F.col("_b.n") >= F.lit(min_frac) * F.col("size"))
        .select("volume_id", instance, F.col("_b.id").alias("class_id"), (-F.col("_b.n")).alias("overlap"), "size")
    )


def region_metrics_2d(labels: DataFrame, volumes: DataFrame, pixel_nm=(5.0, 5.0), block=None) -> DataFrame:
    """Per-slice area, Crofton and face perimeters, circularity, intensity."""
    args = (block,) if block else ()
    hist = square_histogram(labels, volumes, *args)
    table = F.broadcast(square_table(labels.sparkSession))
    rim = hist.join(table, "config").groupBy("volume_id", "z", "label").agg(
        _dot("crofton").alias("perimeter_px"), (_dot("side_halves") / 2).cast("long").alias("face_perimeter_px"))
    body = labels.groupBy("volume_id", "z", "label").agg(
        F.count(F.lit(1)).alias("area_px"), F.avg("raw").alias("mean_intensity"),
        F.min("raw").alias("min_intensity"), F.max("raw").alias("max_intensity"))
    side = (pixel_nm[0] + pixel_nm[1]) / 2
    area = F.col("area_px") * (pixel_nm[0] * pixel_nm[1])
    perim = F.col("perimeter_px") * side
    return body.join(rim, ["volume_id", "z", "label"]).select(
        "*", area.alias("area_nm2"), perim.alias("perimeter_nm"),
        F.when(perim > 0, 4 * F.pi() * area / (perim * perim)).alias("circularity"))


def slice_prompts(labels: DataFrame, min_size: int) -> DataFrame:
    """One point prompt per object and slice: its centroid, if large enough."""
    return (
        labels.groupBy("volume_id", "z", "label")
        .agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("area"))
        .where(F.col("area") >= min_size)
    )


def z_extent(boxes: DataFrame, min_slices: int) -> DataFrame:
    return boxes.select(*OBJECT, (F.col("z1") - F.col("z0") + 1).alias("z_slices")).where(
        F.col("z_slices") >= min_slices)


def nearest_object(centroids: DataFrame, base: float) -> DataFrame:
    """Distance in um to the closest other centroid; NULL for a lone object."""
    coords = [f"centroid_{a}_um" for a in AXES]
    near = nearest(centroids, centroids, ["volume_id"], ["label"], "label", coords, coords, base, exclude_self=True)
    return near.select(*OBJECT, F.col("dist").alias("nearest_neighbor_um"))


def object_core(labels: DataFrame, volumes: DataFrame, size) -> DataFrame:
    """Everything one grouped pass over the voxels gives: count, box, centroid,
    axes, intensity and border contact; materialised, since it is one small row
    per object that several later joins use."""
    core = labels.groupBy(*OBJECT).agg(
        F.count(F.lit(1)).alias("volume_vx"),
        *[f(a).alias(f"{a}{i}") for a in AXES for i, f in ((0, F.min), (1, F.max))],
        *[F.avg(a).alias(f"centroid_{a}_vx") for a in AXES],
        *_moment_aggs(size), *_intensity_aggs())
    core = _axes_from_moments(core).join(volumes.select("volume_id", "nz", "ny", "nx"), "volume_id")
    core = core.withColumn("touches_border", _at_border()).drop("nz", "ny", "nx")
    return cut(core.select(
        "*", (F.col("volume_vx") * _cube(size)).alias("volume_um3"),
        *[(F.col(f"centroid_{a}_vx") * s).alias(f"centroid_{a}_um") for a, s in zip(AXES, size)]))


def object_table(labels: DataFrame, volumes: DataFrame, size, block=None, neighbours: bool = True) -> DataFrame:
    """The full per-object table.  ``labels`` carries ``raw`` and ``cell``.

    Cell overlap and lattice bytes are two more mergeable aggregations of the
    same rows; all later joins are between one-row-per-object tables.
    """
    core = object_core(labels, volumes, size)
    out = core.join(assign_cell(labels), OBJECT, "left").join(
        lattice_measures(labels, volumes, size, block).select(*OBJECT, "euler_char", "surface_um2"), OBJECT, "left")
    vol, surface = F.col("volume_um3"), F.col("surface_um2")
    out = out.withColumn("sphericity", sphericity(vol, surface)).withColumn("sv_ratio", ratio(surface, vol))
    if neighbours:
        cents = core.select(*OBJECT, *[f"centroid_{a}_um" for a in AXES])
        out = out.join(nearest_object(cents, 4 * max(size)), OBJECT, "left")
    else:
        out = out.withColumn("nearest_neighbor_um", F.lit(None).cast("double"))
    return out.select(
        "volume_id", F.col("label").alias("label_id"), "cell_id", "volume_vx", "volume_um3", "surface_um2",
        "sphericity", "sv_ratio", "a_um", "b_um", "c_um", "elongation_a_over_c", "flatness_b_over_c",
        "isotropy_c_over_a", "euler_char", "touches_border",
        *[f"centroid_{a}_vx" for a in AXES], *[f"centroid_{a}_um" for a in AXES],
        "nearest_neighbor_um", "mean_intensity", "min_intensity", "max_intensity", "std_intensity")


def reduce_objects(labels: DataFrame, fn, schema: str, columns: dict, block=BLOCK) -> DataFrame:
    """User reducer over each object's part in a block.

    ``fn(arrays, origin, inner, meta)`` returns partial rows; the caller merges
    them with an ordinary aggregate, so no task ever holds a whole object.
    """
    return map_blocks(labels, fn, schema, columns, block, keys=OBJECT)


def rois(labels: DataFrame, volumes: DataFrame, window, min_voxels: int = 100,
         min_size: int | None = None, euler: int | None = None, block=None) -> DataFrame:
    """One window per object, started at its box and moved inside the volume;
    kept when it holds enough labelled voxels of any object."""
    boxes = bounding_box(labels).join(voxel_count(labels), OBJECT)
    if min_size is not None:
        boxes = boxes.where(F.col("volume_vx") >= min_size)
    if euler is not None:
        shape = lattice_measures(labels, volumes, block=block).where(F.col("euler_char") == euler)
        boxes = boxes.join(shape.select(*OBJECT), OBJECT, "left_semi")
    roi = boxes.join(volumes, "volume_id").select(*OBJECT, *[
        F.greatest(F.lit(0), F.least(F.col(f"{a}0"), F.col(f"n{a}") - w)).cast("long").alias(f"r{a}0")
        for a, w in zip(AXES, window)])
    roi = roi.select("*", *[(F.col(f"r{a}0") + w).alias(f"r{a}1") for a, w in zip(AXES, window)])
    # A window spans at most two cells of its own size per axis, which makes the range join an equi-join.
    starts = roi.select(*[f"r{a}0" for a in AXES], "volume_id").distinct()
    cover = starts
    home = labels.select("volume_id", *AXES)
    for a, w in zip(AXES, window):
        lo = F.floor(F.col(f"r{a}0") / w)
        cover = cover.withColumn(f"_g{a}", F.explode(F.sequence(lo, F.floor((F.col(f"r{a}0") + w - 1) / w))))
        home = home.withColumn(f"_g{a}", F.floor(F.col(a) / w))
    inside = reduce(lambda p, q: p & q, [
        (F.col(a) >= F.col(f"r{a}0")) & (F.col(a) < F.col(f"r{a}0") + w) for a, w in zip(AXES, window)])
    counts = (
        home.join(cover, ["volume_id"] + [f"_g{a}" for a in AXES]).where(inside)
        .groupBy("volume_id", *[f"r{a}0" for a in AXES]).agg(F.count(F.lit(1)).alias("n_foreground")))
    floor = max(min_voxels, min_size or 0)
    return roi.join(counts, ["volume_id"] + [f"r{a}0" for a in AXES]).where(F.col("n_foreground") >= floor)
