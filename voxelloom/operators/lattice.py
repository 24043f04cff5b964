"""Corner-configuration histograms of label volumes.

Each lattice cell (2x2x2 voxels) of an object is one byte: bit ``k`` is set
when corner ``k = 4*dz + 2*dy + dx`` belongs to the object.  The histogram of
those bytes per object is tiny and mergeable, and topology, exposed faces and
iso-surface area are all dot products with a small table that follows from a
rule on the byte.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import AXES, BLOCK, map_blocks
from voxelloom.operators.joins import join_small

CORNERS = list(itertools.product((0, 1), repeat=3))


def _count_cells(corners, base, limits):
    """(label, byte, inside) counts over cells with at least one set corner."""
    found = []
    for k, mine in enumerate(corners):
        fresh = mine > 0
        for earlier in corners[:k]:
            fresh &= earlier != mine
        at = np.nonzero(fresh)
        if not len(at[0]):
            continue
        lab = mine[at]
        byte = sum((c[at] == lab).astype(np.int64) << j for j, c in enumerate(corners))
        inside = np.ones(len(lab), dtype=bool)
        for w, b, n in zip(at, base, limits):
            inside &= (w + b >= 0) & (w + b <= n - 2)
        found.append(np.stack([lab, byte, inside.astype(np.int64)], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(found), axis=0, return_counts=True)


def _cube_kernel(arrays, origin, inner, meta):
    lab = arrays["label"]
    n = [s - 1 for s in lab.shape]
    corners = [lab[dz:dz + n[0], dy:dy + n[1], dx:dx + n[2]] for dz, dy, dx in CORNERS]
    rows, count = _count_cells(corners, origin, [meta["nz"], meta["ny"], meta["nx"]])
    keep = rows[:, 1] != 255
    return pd.DataFrame({"label": rows[keep, 0], "config": rows[keep, 1].astype(np.int32),
                         "inside": rows[keep, 2].astype(bool), "n": count[keep].astype(np.int64)})


def cube_histogram(labels: DataFrame, volumes: DataFrame, block=BLOCK) -> DataFrame:
    """``volume_id, label, config, inside, n``; fully interior cells are left out."""
    parts = map_blocks(
        join_small(labels, volumes.select("volume_id", "nz", "ny", "nx"), ["volume_id"], materialise=False),
        _cube_kernel, "label long, config int, inside boolean, n long",
        {"label": (np.int64, 0)}, block, hi=(1, 1, 1), meta=["nz", "ny", "nx"], below_zero=True)
    return parts.groupBy("volume_id", "label", "config", "inside").agg(F.sum("n").alias("n"))


def _square_kernel(arrays, origin, inner, meta):
    lab = arrays["label"]
    out = []
    for i in range(lab.shape[0]):
        plane = lab[i]
        n = [s - 1 for s in plane.shape]
        corners = [plane[dy:dy + n[0], dx:dx + n[1]] for dy, dx in itertools.product((0, 1), repeat=2)]
        rows, count = _count_cells(corners, origin[1:], [meta["ny"], meta["nx"]])
        out.append(pd.DataFrame({"z": np.int64(origin[0] + i), "label": rows[:, 0],
                                 "config": rows[:, 1].astype(np.int32), "n": count.astype(np.int64)}))
    return pd.concat(out)


def square_histogram(labels: DataFrame, volumes: DataFrame, block=BLOCK) -> DataFrame:
    """Per-slice 2x2 histogram ``volume_id, z, label, config, n``."""
    parts = map_blocks(
        join_small(labels, volumes.select("volume_id", "ny", "nx"), ["volume_id"], materialise=False),
        _square_kernel, "z long, label long, config int, n long",
        {"label": (np.int64, 0)}, block, hi=(0, 1, 1), meta=["ny", "nx"], below_zero=True)
    return parts.groupBy("volume_id", "z", "label", "config").agg(F.sum("n").alias("n"))


def euler_eighths(config: int) -> int:
    """Eight times this cell's share of V - E + F - C for the union of closed cubes."""
    on = {c for k, c in enumerate(CORNERS) if config >> k & 1}
    edges = faces = 0
    for axis, side in itertools.product(range(3), (0, 1)):
        edges += any(c[axis] == side for c in on)
    for axis in range(3):
        for pair in itertools.product((0, 1), repeat=2):
            faces += any([v for i, v in enumerate(c) if i != axis] == list(pair) for c in on)
    return 8 * bool(on) - 4 * edges + 2 * faces - len(on)


def face_quarters(config: int) -> tuple[int, int, int]:
    """Quarters of exposed voxel faces normal to z, y and x in this cell."""
    out = []
    for axis in range(3):
        step = 4 >> axis
        out.append(sum((config >> k & 1) != (config >> (k + step) & 1)
                       for k in range(8) if not k & step))
    return tuple(out)


def _face_links(config: int):
    """Pairs of crossed cube edges joined on each cube face.

    Where only two diagonal corners of a face are set they stay connected, in
    line with 26-connectivity.
    """
    bit = {c: bool(config >> k & 1) for k, c in enumerate(CORNERS)}
    for axis, side in itertools.product(range(3), (0, 1)):
        u, v = [a for a in range(3) if a != axis]
        ring = []
        for du, dv in ((0, 0), (0, 1), (1, 1), (1, 0)):
            c = [0, 0, 0]
            c[axis], c[u], c[v] = side, du, dv
            ring.append(tuple(c))
        cross = [frozenset((ring[i], ring[(i + 1) % 4])) for i in range(4)
                 if bit[ring[i]] != bit[ring[(i + 1) % 4]]]
        if len(cross) == 2:
            yield cross
        elif len(cross) == 4:
            for corner in ring:
                if not bit[corner]:
                    yield [e for e in cross if corner in e]


def iso_area(config: int, spacing) -> float:
    """Area of the 0.5 iso-surface inside one cell: midpoints of the crossed
    edges are chained into loops, each loop is fanned from its centroid."""
    links: dict = {}
    for a, b in _face_links(config):
        links.setdefault(a, []).append(b)
        links.setdefault(b, []).append(a)
    total, todo = 0.0, set(links)
    while todo:
        start = min(todo, key=sorted)
        loop, here = [], start
        while here in todo:
            todo.discard(here)
            loop.append(here)
            here = next((e for e in links[here] if e in todo), start)
        points = np.array([np.mean([np.array(c) for c in e], axis=0) for e in loop]) * np.array(spacing)
        arms = points - points.mean(axis=0)
        total += 0.5 * np.linalg.norm(np.cross(arms, np.roll(arms, -1, axis=0)), axis=1).sum()
    return float(total)


def config_table(spark, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """The 256 cell measures for one voxel spacing."""
    rows = [(c, euler_eighths(c), *face_quarters(c), iso_area(c, spacing)) for c in range(256)]
    return spark.createDataFrame(rows, "config int, euler8 int, face_z int, face_y int, face_x int, iso double")


# Crofton perimeter weights (four directions) by 2x2 byte, where
# bit 0 is the lower-right pixel, bit 1 the upper-right, bit 2 the lower-left
# and bit 3 the upper-left one.
_S = 1 / math.sqrt(2)
CROFTON = [
    0, math.pi / 4 * (1 + _S), math.pi / 4 * _S, math.pi / 2 * _S,
    0, math.pi / 4 * (1 + _S), 0, math.pi / 4 * _S,
    math.pi / 4, math.pi / 2, math.pi / 4 * _S, math.pi / 4 * _S,
    math.pi / 4, math.pi / 2, 0, 0,
]


def crofton_weight(config: int) -> float:
    """Weight of a row-major 2x2 byte (bit ``2*dy + dx``)."""
    upper_left, upper_right, lower_left, lower_right = (config >> k & 1 for k in range(4))
    return CROFTON[lower_right + 2 * upper_right + 4 * lower_left + 8 * upper_left]


def square_table(spark) -> DataFrame:
    rows = [(c, float(crofton_weight(c)),
             sum((c >> a & 1) != (c >> b & 1) for a, b in ((0, 1), (2, 3), (0, 2), (1, 3))))
            for c in range(16)]
    return spark.createDataFrame(rows, "config int, crofton double, side_halves int")
