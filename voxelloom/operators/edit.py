"""Merging, filtering and editing whole label volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import AXES, BLOCK, block_grid, gather, inner_origin, map_blocks
from voxelloom.operators.components import VOXEL, components, solve_graph
from voxelloom.operators.joins import join_small
from voxelloom.operators.labels import overlaps
from voxelloom.operators.morphology import element, holes, morph, volume_boxes
from voxelloom.operators.ordered import dense_index, prefix_totals
from voxelloom.session import cut


def identity_halo(vox: DataFrame, value: str, radius: int, block=BLOCK) -> DataFrame:
    """Box sum of ``value`` over the halo, the reference use of the halo map."""

    def kernel(arrays, origin, inner, meta):
        total = arrays[value].astype(np.float64)
        for axis in range(3):
            total = sum(np.roll(total, k, axis) for k in range(-radius, radius + 1))
        return gather((arrays["_on"] > 0)[inner], inner_origin(origin, inner), box_sum=total[inner], **{value: arrays[value][inner]})

    rows = vox.select(*VOXEL, value, F.lit(1).alias("_on"))
    return map_blocks(rows, kernel, f"z long, y long, x long, box_sum double, {value} double",
                      {value: (np.float64, 0.0), "_on": (np.int8, 0)}, block, lo=(radius,) * 3, hi=(radius,) * 3, core_only=True)


def map_with_halo(vox: DataFrame, fn, schema: str, columns: dict, radius: int, block=BLOCK) -> DataFrame:
    """User function over dense boxes with a halo; ``fn(arrays) -> dict`` of
    arrays on the same box, of which the inner part is kept for stored voxels."""

    def kernel(arrays, origin, inner, meta):
        stored = arrays.pop("_on") > 0
        out = fn(arrays)
        return gather(stored[inner], inner_origin(origin, inner), **{n: v[inner] for n, v in out.items()})

    rows = vox.select(*VOXEL, *columns, F.lit(1).alias("_on"))
    return map_blocks(rows, kernel, "z long, y long, x long, " + schema, {**columns, "_on": (np.int8, 0)}, block,
                      lo=(radius,) * 3, hi=(radius,) * 3, core_only=True)


def merge_segmentations(seg1: DataFrame, seg2: DataFrame, threshold: float) -> DataFrame:
    """Second labels written over the first.

    A first object goes entirely when its overlap exceeds ``threshold`` of some
    second object.  Second objects get ids above the first's largest, in
    ascending order of their old id.
    """
    a = seg1.select(*VOXEL, F.col("label").alias("a"))
    b = seg2.select(*VOXEL, F.col("label").alias("b"))
    pairs = a.join(b, VOXEL).groupBy("volume_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    size2 = b.groupBy("volume_id", "b").agg(F.count(F.lit(1)).alias("n2"))
    gone = pairs.join(size2, ["volume_id", "b"]).where(F.col("n") / F.col("n2") > threshold).select("volume_id", "a").distinct()
    kept = join_small(a, gone, ["volume_id", "a"], "left_anti")
    top = a.groupBy("volume_id").agg(F.max("a").alias("_top"))
    ids = prefix_totals(size2, ["volume_id"], ["b"]).join(top, "volume_id", "left").select(
        "volume_id", "b", (F.coalesce("_top", F.lit(0)) + F.col("rn")).alias("new"))
    second = join_small(b, ids, ["volume_id", "b"])
    return kept.join(second, VOXEL, "full").select(*VOXEL, F.coalesce("new", "a").alias("label"))


def with_inner(labels: DataFrame, inner: DataFrame) -> DataFrame:
    """Each object with ``has_inner``: whether any inner voxel lies in it."""
    hit = labels.join(inner.select(*VOXEL), VOXEL, "left_semi").select("volume_id", "label").distinct()
    objects = labels.select("volume_id", "label").distinct()
    return objects.join(hit.withColumn("_h", F.lit(True)), ["volume_id", "label"], "left").select(
        "volume_id", "label", F.coalesce("_h", F.lit(False)).alias("has_inner"))


def keep_with_inner(labels: DataFrame, inner: DataFrame) -> DataFrame:
    keep = with_inner(labels, inner).where("has_inner")
    return join_small(labels, keep.select("volume_id", "label"), ["volume_id", "label"], "left_semi")


def object_states(labels: DataFrame, inner: DataFrame) -> DataFrame:
    """State 1 for objects with inner labels, 2 for the others, on every voxel."""
    flags = with_inner(labels, inner)
    return join_small(labels, flags, ["volume_id", "label"]).select(*VOXEL, F.when(F.col("has_inner"), 1).otherwise(2).cast("long").alias("state"))


def additional_objects(vox: DataFrame, gt: str, pred: str, max_iou: float) -> DataFrame:
    """Predicted objects that overlap no reference object by more than
    ``max_iou``, renumbered 1..N."""
    matched = overlaps(vox, gt, pred).where(F.col("iou") > max_iou).select("volume_id", pred).distinct()
    rest = join_small(vox.where(F.col(pred) > 0), matched, ["volume_id", pred], "left_anti")
    return dense_index(rest.select(*VOXEL, pred), ["volume_id"], pred, "label").select(*VOXEL, "label")


def add_missing(vox: DataFrame, gt: str, pred: str, max_iou: float, block=BLOCK) -> DataFrame:
    """Union of the reference objects and the additional ones, as components."""
    extra = additional_objects(vox, gt, pred, max_iou).select(*VOXEL)
    both = vox.where(F.col(gt) > 0).select(*VOXEL).unionByName(extra).distinct().withColumn("label", F.lit(1).cast("long"))
    return components(both, 26, False, block).select(*VOXEL, "component")


def link_slices(slices: DataFrame, min_iou: float = 0.5, max_gap: int = 1, min_slices: int = 1) -> DataFrame:
    """2-D instances joined through z when they overlap enough.

    ``slices``: voxels with a per-slice ``label``.  Instances at most
    ``max_gap`` slices apart are compared; chains become one object named by
    its first (z, number of the label in its slice).  Labels may be any ids.
    """
    numbered = dense_index(slices.select(*VOXEL, "label"), ["volume_id", "z"], "label", "_n")
    rows = numbered.select(*VOXEL, (F.shiftleft(F.col("z"), 42) + F.col("_n")).alias("node"))
    size = rows.groupBy("volume_id", "node").agg(F.count(F.lit(1)).alias("n"))
    up = rows.select("volume_id", F.explode(F.sequence(F.lit(1), F.lit(max_gap))).alias("_d"), "z", "y", "x", F.col("node").alias("a"))
    up = up.select("volume_id", (F.col("z") + F.col("_d")).alias("z"), "y", "x", "a")
    pairs = up.join(rows.withColumnRenamed("node", "b"), VOXEL).groupBy("volume_id", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    pairs = pairs.join(size.withColumnsRenamed({"node": "a", "n": "na"}), ["volume_id", "a"]).join(
        size.withColumnsRenamed({"node": "b", "n": "nb"}), ["volume_id", "b"])
    edges = pairs.where(F.col("o") / (F.col("na") + F.col("nb") - F.col("o")) >= min_iou).select("volume_id", "a", "b")
    roots = solve_graph(edges, ["volume_id"])
    named = rows.join(roots, ["volume_id", "node"], "left").select(*VOXEL, F.coalesce("root", "node").alias("label"))
    if min_slices > 1:
        tall = named.groupBy("volume_id", "label").agg((F.max("z") - F.min("z") + 1).alias("d")).where(F.col("d") >= min_slices)
        named = named.join(tall, ["volume_id", "label"], "left_semi")
    return named


def average_predictions(predictions: DataFrame, value: str) -> DataFrame:
    """Mean over the stacked predictions of each voxel."""
    return predictions.groupBy(*VOXEL).agg(F.avg(value).alias(value))


def split_blocks(vox: DataFrame, volumes: DataFrame, block, min_tail: int = 0) -> DataFrame:
    """Voxels tagged with their block and shifted to its corner."""
    grid = block_grid(volumes, block, min_tail)
    out = vox
    for a, b in zip(AXES, block):
        out = out.withColumn(f"_b{a}", F.floor(F.col(a) / b))
    # a merged tail belongs to the block before it
    top = grid.groupBy("volume_id").agg(*[F.max(f"b{a}").alias(f"_m{a}") for a in AXES])
    out = join_small(out, top, ["volume_id"])
    for a, b in zip(AXES, block):
        out = out.withColumn(f"b{a}", F.least(f"_b{a}", f"_m{a}").cast("long"))
        out = out.withColumn(f"{a}0", F.col(f"b{a}") * b)
        out = out.withColumn(a, F.col(a) - F.col(f"{a}0"))
    return out.select(*[f"b{a}" for a in AXES], *[f"{a}0" for a in AXES], *vox.columns)


def stitch_blocks(tagged: DataFrame) -> DataFrame:
    """Back to volume coordinates."""
    drop = [f"b{a}" for a in AXES] + [f"{a}0" for a in AXES]
    return tagged.select(*[(F.col(c) + F.col(f"{c}0")).alias(c) if c in AXES else c for c in tagged.columns if c not in drop])


def apply_edits(labels: DataFrame, edits: DataFrame, volumes: DataFrame, block=BLOCK) -> DataFrame:
    """Per-object edits: ``edits(volume_id, label, op, arg, seq)``.

    ``dilate`` / ``erode`` by ``arg`` steps, ``fill`` holes of at most ``arg``
    pixels per slice, ``delete`` when smaller than ``arg``.  Each edit works on
    the object as given; its old voxels are cleared and the new mask written
    over others, the highest ``seq`` winning.
    """
    key = ["volume_id", "label", "seq"]
    base = cut(labels.join(edits, ["volume_id", "label"]).select(*VOXEL, "label", "op", "arg", "seq"))
    untouched = labels.join(edits.select("volume_id", "label").distinct(), ["volume_id", "label"], "left_anti")
    boxes = edits.select("volume_id", "label").distinct().join(volume_boxes(volumes), "volume_id")
    written = []
    args = [(r["op"], r["arg"]) for r in base.select("op", "arg").distinct().orderBy("op", "arg").collect()]  # one row per edit kind
    for op, arg in args:
        rows = base.where((F.col("op") == op) & (F.col("arg") == arg)).select(*VOXEL, "label", "seq")
        seqs = rows.select(*key).distinct()
        if op == "delete":
            keep = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= arg)
            out = rows.join(keep, key, "left_semi")
        elif op == "fill":
            extra = holes(rows.select(*VOXEL, "label").distinct(), int(arg), per_slice=True, inclusive=True, block=block)
            out = rows.unionByName(extra.join(seqs, ["volume_id", "label"]).select(*VOXEL, "label", "seq"))
        else:
            shaped = morph(rows.select(*VOXEL, "label").distinct(), boxes, op, element("cross"), int(arg), block, ["volume_id", "label"])
            out = shaped.join(seqs, ["volume_id", "label"]).select(*VOXEL, "label", "seq")
        written.append(out)
    claims = untouched.select(*VOXEL, "label", F.lit(-1).cast("long").alias("seq"))
    for w in written:
        claims = claims.unionByName(w.select(*VOXEL, "label", F.col("seq").cast("long").alias("seq")))
    return claims.groupBy(*VOXEL).agg(F.max(F.struct("seq", "label")).alias("_c")).select(*VOXEL, F.col("_c.label").alias("label"))
