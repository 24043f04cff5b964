"""Binary morphology on blocks with a halo as wide as the structuring element."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import AXES, BLOCK, gather, inner_origin, map_blocks
from voxelloom.operators.components import face_edges, local_components, pack_roots, solve_graph
from voxelloom.operators.joins import join_small
from voxelloom.operators.labels import offsets
from voxelloom.operators.objects import OBJECT, bounding_box
from voxelloom.session import cut

VOXEL = ["volume_id", "z", "y", "x"]
BOX = [f"{a}{i}" for a in AXES for i in (0, 1)]


def element(kind: str, radius: int = 1) -> list[tuple[int, int, int]]:
    """Offsets of a structuring element, centre included."""
    r = range(-radius, radius + 1)
    inside = {
        "cross": lambda z, y, x: abs(z) + abs(y) + abs(x) <= 1,
        "ball": lambda z, y, x: z * z + y * y + x * x <= radius * radius,
        "disk": lambda z, y, x: z == 0 and y * y + x * x <= radius * radius,
        "square": lambda z, y, x: z == 0,
        "cube": lambda z, y, x: True,
        "zline": lambda z, y, x: y == 0 and x == 0,
    }[kind]
    return [(z, y, x) for z in r for y in r for x in r if inside(z, y, x)]


def shifted(mask: np.ndarray, off) -> np.ndarray:
    """``out[p] = mask[p + off]``, False outside the array."""
    out = np.zeros_like(mask)
    dst = tuple(slice(max(0, -o), n - max(0, o)) for o, n in zip(off, mask.shape))
    src = tuple(slice(max(0, o), n - max(0, -o)) for o, n in zip(off, mask.shape))
    out[dst] = mask[src]
    return out


def _dilate(mask, elem, times, domain):
    for _ in range(times):
        out = np.zeros_like(mask)
        for off in elem:
            out |= shifted(mask, off)
        mask = out & domain
    return mask


def _erode(mask, elem, times):
    for _ in range(times):
        out = np.ones_like(mask)
        for off in elem:
            out &= shifted(mask, off)
        mask = out
    return mask


def _inside(shape, origin, meta, low: list[str], high: list[str]):
    """Voxels of the array inside the box of this key (half-open)."""
    domain = np.ones(shape, dtype=bool)
    for axis, (lo, hi) in enumerate(zip(low, high)):
        at = np.arange(shape[axis]) + origin[axis]
        ok = (at >= meta[lo]) & (at < meta[hi])
        domain &= ok.reshape([-1 if i == axis else 1 for i in range(3)])
    return domain


def morph(mask: DataFrame, boxes: DataFrame, op: str, elem, times: int = 1, block=BLOCK, keys=("volume_id",)) -> DataFrame:
    """``op`` in dilate, erode, close.

    ``boxes`` bounds each key (``z0..x1`` half-open): nothing grows out of the
    box, and outside it counts as unset for erosion.
    """
    reach = [max(abs(o[i]) for o in elem) * times * (2 if op == "close" else 1) for i in range(3)]
    keys = list(keys)

    def kernel(arrays, origin, inner, meta):
        m = arrays["_on"]
        if op == "erode":
            out = _erode(m, elem, times)
        else:
            domain = _inside(m.shape, origin, meta, BOX[::2], BOX[1::2])
            out = _dilate(m, elem, times, domain)
            if op == "close":
                out = _erode(out, elem, times)
        return gather(out[inner], inner_origin(origin, inner))

    rows = join_small(mask.select(*keys, *AXES, F.lit(True).alias("_on")), boxes.select(*keys, *BOX), keys)
    return map_blocks(rows, kernel, "z long, y long, x long", {"_on": (np.bool_, False)}, block,
                      lo=reach, hi=reach, meta=BOX, keys=keys)


def volume_boxes(volumes: DataFrame) -> DataFrame:
    return volumes.select("volume_id", *[e for a in AXES for e in (
        F.lit(0).cast("long").alias(f"{a}0"), F.col(f"n{a}").alias(f"{a}1"))])


def object_boxes(labels: DataFrame) -> DataFrame:
    box = bounding_box(labels)
    return box.select(*OBJECT, *[e for a in AXES for e in (F.col(f"{a}0"), (F.col(f"{a}1") + 1).alias(f"{a}1"))])


def holes(labels: DataFrame, max_size: int, per_slice: bool = False, inclusive: bool = False, block=BLOCK) -> DataFrame:
    """Voxels of small background components in each object's box.

    ``volume_id, label, z, y, x`` of components with fewer than ``max_size``
    voxels (or at most that many with ``inclusive``), 6-connected, or
    4-connected inside each slice.  Only face layers and components that are
    small inside their block leave the kernel.
    """
    limit = max_size + 1 if inclusive else max_size
    offs = [o for o in offsets(6) if not (per_slice and o[0])]
    boxes = cut(object_boxes(labels))
    visit = boxes
    for a, b in zip(AXES, block):
        visit = visit.withColumn(f"b{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / b), F.floor((F.col(f"{a}1") - 1) / b))))

    def kernel(arrays, origin, inner, meta):
        gap = _inside(arrays["_on"].shape, origin, meta, BOX[::2], BOX[1::2]) & ~arrays["_on"]
        root = local_components(gap.astype(np.int8), offs)
        size = np.bincount(root[gap], minlength=gap.size)[root]
        face = np.zeros_like(gap)
        for axis in range(3):
            for end in (0, -1):
                face[tuple(end if i == axis else slice(None) for i in range(3))] = True
        return gather(gap & (face | (size < limit)), origin, node=pack_roots(root, origin), size=size)

    rows = join_small(labels.select(*OBJECT, *AXES, F.lit(True).alias("_on")), boxes, OBJECT, materialise=False)
    local = cut(map_blocks(rows, kernel, "z long, y long, x long, node long, size long", {"_on": (np.bool_, False)},
                           block, meta=BOX, keys=OBJECT, boxes=visit))
    roots = solve_graph(face_edges(local, block, offs, OBJECT), OBJECT)
    nodes = local.select(*OBJECT, "node", "size").distinct().join(roots, OBJECT + ["node"], "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    small = nodes.groupBy(*OBJECT, "root").agg(F.sum("size").alias("total")).where(F.col("total") < limit)
    fill = nodes.join(small, OBJECT + ["root"]).select(*OBJECT, "node")
    return local.join(fill, OBJECT + ["node"], "left_semi").select(*OBJECT, *AXES)


def resolve_claims(claims: DataFrame) -> DataFrame:
    """One label per voxel; the higher id wins."""
    return claims.groupBy(*VOXEL).agg(F.max("label").alias("label"))


def fill_holes(labels: DataFrame, max_size: int, per_slice: bool = False, inclusive: bool = False, block=BLOCK) -> DataFrame:
    claims = labels.select(*VOXEL, "label").unionByName(holes(labels, max_size, per_slice, inclusive, block).select(*VOXEL, "label"))
    return resolve_claims(claims)


def clean_objects(labels: DataFrame, area: int = 1000, times: int = 4, times_plane: int = 8, block=BLOCK) -> DataFrame:
    """Per object: fill small holes, close in 3-D, close in plane; written back
    only where set."""
    rows = labels.select(*OBJECT, *AXES)
    boxes = cut(object_boxes(labels))
    rows = cut(rows.unionByName(holes(labels, area, block=block)).distinct())
    for elem, n in ((element("cross"), times), (element("square"), times_plane)):
        closed = morph(rows, boxes, "close", elem, n, block, OBJECT)
        rows = cut(rows.unionByName(closed.select(*OBJECT, *AXES)).distinct())
    return resolve_claims(rows)
