"""Connected components across blocks.

Components are found inside each block first; only voxels on block faces are
compared across blocks, so the graph that is solved globally has one node per
(block, local component).  A component is named by the packed coordinate of
its first voxel in scan order, which does not depend on the block size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import AXES, BLOCK, map_blocks
from voxelloom.operators.joins import join_small
from voxelloom.operators.labels import offsets
from voxelloom.session import cut

VOXEL = ["volume_id", "z", "y", "x"]
BITS = 21  # coordinates below two million per axis fit one long; larger ones fail


def pack(z: Column, y: Column, x: Column) -> Column:
    packed = F.shiftleft(z.cast("long"), 2 * BITS) + F.shiftleft(y.cast("long"), BITS) + x.cast("long")
    fits = (F.least(z, y, x) >= 0) & (F.greatest(z, y, x) < (1 << BITS))
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("coordinate beyond the packed range")).cast("long"))


def local_components(values: np.ndarray, offs) -> np.ndarray:
    """Flat index of the first voxel of each voxel's component (same value,
    adjacent by ``offs``), by hooking and pointer jumping."""
    flat = np.arange(values.size).reshape(values.shape)
    pairs = []
    for off in offs:
        if off <= (0, 0, 0):
            continue
        here = tuple(slice(max(0, -o), n - max(0, o)) for o, n in zip(off, values.shape))
        there = tuple(slice(max(0, o), n - max(0, -o)) for o, n in zip(off, values.shape))
        same = (values[here] == values[there]) & (values[here] != 0)
        pairs.append(np.stack([flat[here][same], flat[there][same]]))
    u, v = np.concatenate(pairs, axis=1)
    root = np.arange(values.size)
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root.reshape(values.shape)
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def pack_roots(root: np.ndarray, origin) -> np.ndarray:
    z, y, x = np.unravel_index(root, root.shape)
    if min(origin) < 0 or max(o + n for o, n in zip(origin, root.shape)) > 1 << BITS:
        raise ValueError("coordinate beyond the packed range")
    return ((z + origin[0]) << 2 * BITS) + ((y + origin[1]) << BITS) + (x + origin[2])


def solve_graph(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, root`` (smallest node of the component) for all nodes that
    occur in ``edges`` (keys, a, b), by alternating large and small stars."""

    def tidy(df):
        return df.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    now = cut(tidy(edges))
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        # large star: every neighbour above u is hung on the smallest of u's neighbourhood
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, keys + ["a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(tidy(large))
        # small star: all lower neighbours of a are hung on the smallest of them
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        low = large.join(least, keys + ["a"])
        small = low.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(*keys, "a", F.col("m").alias("b")))
        now = cut(tidy(small))


def face_edges(local: DataFrame, block, offs, keys: list[str], value: str | None = None) -> DataFrame:
    """Pairs of local roots that touch across a block face."""
    steps = [o for o in offs if o > (0, 0, 0)]
    on_face = F.lit(False)
    for a, b in zip(AXES, block):
        on_face = on_face | (F.pmod(a, F.lit(b)) == 0) | (F.pmod(a, F.lit(b)) == b - 1)
    rim = local.where(on_face).select(*keys, *AXES, "node", *([value] if value else []))
    shift = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("dz", "dy", "dx"))]) for o in steps]))
    moved = rim.select(*keys, F.col("node").alias("a"), *([F.col(value).alias("_v")] if value else []),
                       *[F.col(a).alias(f"_{a}") for a in AXES], shift.alias("_o"))
    moved = moved.select("*", *[(F.col(f"_{a}") + F.col(f"_o.d{a}")).alias(a) for a in AXES])
    crosses = F.lit(False)
    for a, b in zip(AXES, block):
        crosses = crosses | (F.floor(F.col(a) / b) != F.floor(F.col(f"_{a}") / b))
    pairs = moved.where(crosses).join(rim.withColumnRenamed("node", "b"), keys + list(AXES))
    if value:
        pairs = pairs.where(F.col("_v") == F.col(value))
    return pairs.select(*keys, "a", "b").distinct()


def components(labels: DataFrame, connectivity: int = 26, same_value: bool = True, block=BLOCK) -> DataFrame:
    """``volume_id, z, y, x, label, component`` for foreground voxels.

    ``same_value`` keeps differently labelled neighbours apart; otherwise all
    foreground voxels count as one value.
    """
    offs = offsets(connectivity)

    def kernel(arrays, origin, inner, meta):
        lab = arrays["label"]
        root = pack_roots(local_components(lab if same_value else (lab != 0).astype(np.int8), offs), origin)
        at = np.nonzero(lab)
        out = {a: (w + o).astype(np.int64) for a, w, o in zip(AXES, at, origin)}
        return {**out, "label": lab[at], "node": root[at]}

    local = cut(map_blocks(labels, kernel, "z long, y long, x long, label long, node long", {"label": (np.int64, 0)}, block))
    edges = face_edges(local, block, offs, ["volume_id"], "label" if same_value else None)
    roots = solve_graph(edges, ["volume_id"])
    return local.join(roots, ["volume_id", "node"], "left").select(
        *VOXEL, "label", F.coalesce("root", "node").alias("component"))


def component_sizes(comps: DataFrame, *keys: str) -> DataFrame:
    return comps.groupBy("volume_id", *keys, "component").agg(F.count(F.lit(1)).alias("size"))


def largest_per_label(labels: DataFrame, connectivity: int = 26, min_island: int = 0, block=BLOCK) -> DataFrame:
    """Keep the biggest component of each label (the first one on ties), and
    further islands of at least ``min_island`` voxels when that is set."""
    comps = cut(components(labels, connectivity, True, block))
    sizes = component_sizes(comps, "label")
    top = sizes.groupBy("volume_id", "label").agg(F.min(F.struct((-F.col("size")).alias("s"), "component")).alias("_t"))
    keep = top.select("volume_id", F.col("_t.component").alias("component"))
    if min_island:
        keep = keep.unionByName(sizes.where(F.col("size") >= min_island).select("volume_id", "component")).distinct()
    return join_small(comps, keep, ["volume_id", "component"], "left_semi").select(*VOXEL, "label")


def drop_small_components(labels: DataFrame, min_size: int, same_value: bool = True, connectivity: int = 26, block=BLOCK) -> DataFrame:
    comps = cut(components(labels, connectivity, same_value, block))
    keep = component_sizes(comps).where(F.col("size") >= min_size)
    return join_small(comps, keep, ["volume_id", "component"], "left_semi").select(*VOXEL, "label")


def size_filter(labels: DataFrame, min_size: int) -> DataFrame:
    """Labels with fewer voxels than ``min_size`` become background."""
    keep = labels.groupBy("volume_id", "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    return join_small(labels, keep.select("volume_id", "label"), ["volume_id", "label"], "left_semi")


def zero_patches(vox: DataFrame, value: str, patch: Column, min_size: int | None, connectivity: int = 26, block=BLOCK) -> DataFrame:
    """Set ``value`` to 0 in big components of ``patch`` voxels, or in the
    single largest one per volume when ``min_size`` is None."""
    mask = vox.where(patch).select(*VOXEL, F.lit(1).cast("long").alias("label"))
    comps = cut(components(mask, connectivity, False, block))
    sizes = component_sizes(comps)
    if min_size is None:
        top = sizes.groupBy("volume_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "component")).alias("_t"))
        hit = top.select("volume_id", F.col("_t.component").alias("component"))
    else:
        hit = sizes.where(F.col("size") >= min_size)
    dark = join_small(comps, hit.select("volume_id", "component"), ["volume_id", "component"], "left_semi").select(*VOXEL, F.lit(True).alias("_dark"))
    return vox.join(dark, VOXEL, "left").withColumn(
        value, F.when(F.col("_dark"), F.lit(0)).otherwise(F.col(value))).drop("_dark")
