"""Exact nearest site of every asking voxel by separable lower envelopes.

The squared distance is a sum over axes, so it is minimised one axis at a time:
along x to the sites of each line, then along y and z over what the axis before
found.  On a line every candidate is a parabola; their lower envelope is built
and read once, whatever the distances are, so the work per voxel is constant.

Lines travel in tiles of ``TILE`` x ``TILE``: a pass groups one column of tiles
along its axis (bounded by the side of the volume) and hands tiles of squared
distances and labels, as binary rows, to the next.  Tiles are made only where
an asking voxel can need them.  With spacings of a common unit all arithmetic is in integers,
so ties are found exactly and go to the smaller label.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import arrow_table
from voxelloom.session import cut, parallelism

TILE = 16
SHORT = 48  # length of a line up to which every pair is compared: fewer and larger steps than an envelope takes
NONE = np.iinfo(np.int64).max  # label of no site
AXES = ("z", "y", "x")


def integer_weights(spacing) -> tuple[list[int | float], float, type]:
    """Squared spacing per axis in a common unit, the unit, and the number type."""
    parts = [Fraction(str(float(s))) for s in spacing]
    base = lcm(*(p.denominator for p in parts))
    steps = [int(p * base) for p in parts]
    common = gcd(*steps)
    steps = [s // common for s in steps]
    if max(steps) <= 1 << 10:
        return [s * s for s in steps], common / base, np.int64
    return [float(s) ** 2 for s in spacing], 1.0, np.float64


def far_of(kind) -> float | int:
    """Squared distance where there is no site."""
    return np.iinfo(np.int64).max if kind is np.int64 else np.inf


def sweep(height: np.ndarray, label: np.ndarray, pos: np.ndarray, at: np.ndarray, weight, far) -> tuple[np.ndarray, np.ndarray, int]:
    """Best squared distance and its smallest label at places ``at`` of every
    line (columns), from parabolas of the given heights at ascending places
    ``pos``; and the number of vector steps taken."""
    n, lines = height.shape
    if height.dtype == np.int64 and n and 3 * weight * (int(max(pos[-1], at[-1])) - int(min(pos[0], at[0])) + 1) ** 3 >= 1 << 62:
        raise ValueError("line too long for exact distances at this spacing")
    best, which = np.full((len(at), lines), far, height.dtype), np.full((len(at), lines), NONE)
    if not n or not len(at):
        return best, which, 0
    start = pos[0]
    pos, at = pos - start, at - start
    stack, top, steps = np.zeros((n, lines), np.int64), np.full(lines, -1), 0
    lifted = np.where(height < far, height, 0) + (weight * pos * pos)[:, None].astype(height.dtype)
    for k in range(n):
        new = np.flatnonzero(height[k] < far)
        open_ = new[top[new] >= 1]
        while len(open_):  # the last parabola goes where it is nowhere lowest; one that ties somewhere stays
            steps += 1
            q, p = stack[top[open_], open_], stack[top[open_] - 1, open_]
            fq = lifted[q, open_]
            under = (fq - lifted[p, open_]) * (pos[k] - pos[q]) > (lifted[k, open_] - fq) * (pos[q] - pos[p])
            open_ = open_[under]
            top[open_] -= 1
            open_ = open_[top[open_] >= 1]
        top[new] += 1
        stack[top[new], new] = k
        steps += 1
    some = np.flatnonzero(top >= 0)
    here = np.zeros(lines, np.int64)

    def value(index, column, place):
        k = stack[index, column]
        return height[k, column] + weight * (place - pos[k]) ** 2

    for i, place in enumerate(at):
        now = value(here[some], some, place)
        open_ = np.arange(len(some))
        while True:
            steps += 1
            open_ = open_[here[some[open_]] < top[some[open_]]]
            after = value(here[some[open_]] + 1, some[open_], place)
            lower = after < now[open_]
            open_ = open_[lower]
            if not len(open_):
                break
            here[some[open_]] += 1
            now[open_] = after[lower]
        best[i, some] = now
        names = label[stack[here[some], some], some]
        ahead, open_ = here[some].copy(), np.arange(len(some))
        while True:  # those that tie stand next on the envelope
            open_ = open_[ahead[open_] < top[some[open_]]]
            open_ = open_[value(ahead[open_] + 1, some[open_], place) == now[open_]]
            if not len(open_):
                break
            steps += 1
            ahead[open_] += 1
            names[open_] = np.minimum(names[open_], label[stack[ahead[open_], some[open_]], some[open_]])
        which[i, some] = names
    return best, which, steps


def compare(height: np.ndarray, label: np.ndarray, pos: np.ndarray, at: np.ndarray, weight, far) -> tuple[np.ndarray, np.ndarray]:
    """What ``sweep`` finds, for short lines: the parabolas one after the other, all places and lines at once."""
    top = far if height.dtype != np.int64 else 1 << 61  # above all sums of bounded lines, and no sum overflows
    lifted = np.minimum(height, top)
    best = np.full((len(at), height.shape[1]), top, height.dtype)
    some = label[height < far]
    alike = not len(some) or some.min() == some.max()
    which = np.full(best.shape, NONE)
    for k in np.flatnonzero((height < far).any(axis=1)):
        now = lifted[k] + (weight * (at - pos[k]) ** 2)[:, None].astype(height.dtype)
        if not alike:
            tie = np.where(now == best, np.minimum(which, label[k]), which)
            which = np.where(now < best, label[k], tie)
        np.minimum(best, now, out=best)
    found = best < top
    if alike and len(some):
        which[found] = some[0]
    return np.where(found, best, far), np.where(found, which, NONE)


def lowest(height: np.ndarray, label: np.ndarray, pos: np.ndarray, at: np.ndarray, weight, far) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate([pos, at])
    short = len(both) and both.max() - both.min() < SHORT
    return compare(height, label, pos, at, weight, far) if short else sweep(height, label, pos, at, weight, far)[:2]


def spread(tiles) -> np.ndarray:
    """Coordinates of the given tiles."""
    return (np.sort(np.asarray(tiles, np.int64))[:, None] * TILE + np.arange(TILE)).ravel()


def nearest_site(asking: DataFrame, sites: DataFrame, spacing=(1.0, 1.0, 1.0), keys=("volume_id",), carry=()) -> DataFrame:
    """``keys, z, y, x, dist, label`` of every asking voxel: distance to the
    nearest site of the same keys and its label (the smallest on ties; without
    a ``label`` column all sites are 0).  Both are null where there is no site.
    ``carry``: further columns of ``asking``, of plain types, that come after these."""
    keys, carry = list(keys), list(carry)
    weights, unit, kind = integer_weights(spacing)
    far = far_of(kind)
    shape = (TILE,) * 3
    spark = asking.sparkSession
    tile = {a: F.floor(F.col(a) / TILE).alias(f"t{a}") for a in AXES}
    types = ", ".join(f"{k} {asking.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, tz long, ty long, tx long, d binary, l binary"
    names = [*keys, "tz", "ty", "tx", "d", "l"]
    more = "".join(f", {c} {asking.schema[c].dataType.simpleString()}" for c in carry)
    answer = f"{types}, z long, y long, x long, dist double, label long{more}"
    asked = cut(asking.select(*keys, *AXES, *carry, *tile.values()))
    spots = asked.select(*keys, "ty", "tx").distinct()
    wanted_x = spots.groupBy(*keys).agg(F.collect_set("tx").alias("want"))  # at most side / TILE numbers per key
    wanted_y = spots.groupBy(*keys, "tx").agg(F.collect_set("ty").alias("want"))

    def emit(key, fixed, moving, values, which, order):
        """Tiles of one pass: ``moving`` tile numbers along the swept axis."""
        rows = []
        for i, t in enumerate(moving):
            part, name = (m[i * TILE : (i + 1) * TILE].reshape(shape).transpose(order) for m in (values, which))
            if (part < far).any():
                rows.append((*key, *fixed(t), part.tobytes(), name.tobytes()))
        return arrow_table(schema, **dict(zip(names, zip(*rows) if rows else [()] * len(names))))

    def wanted(table):
        return np.sort(np.array(table["want"][0].as_py(), np.int64))

    def along_x(key, table):
        *key, tz, ty = (k.as_py() for k in key)
        pos, column = np.unique(table["x"].to_numpy(), return_inverse=True)
        line = (table["z"].to_numpy() - tz * TILE) * TILE + table["y"].to_numpy() - ty * TILE
        height, label = np.full((len(pos), TILE * TILE), far, kind), np.full((len(pos), TILE * TILE), NONE)
        height[column, line] = 0
        np.minimum.at(label, (column, line), table["label"].to_numpy())
        moving = wanted(table)
        best, which = lowest(height, label, pos, spread(moving), weights[2], far)
        return emit(key, lambda t: (tz, ty, int(t)), moving, best, which, (1, 2, 0))

    def column(table, axis, order):
        """Heights and labels of a column of tiles, the swept axis first."""
        place = table[axis].to_numpy()
        both = []
        for name, dtype in (("d", kind), ("l", np.int64)):
            cells = table[name].to_pylist()
            tiles = [np.frombuffer(cells[i], dtype).reshape(shape).transpose(order).reshape(TILE, -1) for i in np.argsort(place)]
            both.append(np.concatenate(tiles) if tiles else np.empty((0, TILE * TILE), dtype))
        return *both, spread(place)

    def along_y(key, table):
        *key, tz, tx = (k.as_py() for k in key)
        moving = wanted(table)
        best, which = lowest(*column(table, "ty", (1, 0, 2)), spread(moving), weights[1], far)
        return emit(key, lambda t: (tz, int(t), tx), moving, best, which, (1, 0, 2))

    def along_z(key, tiles, ask):
        *_, ty, tx = (k.as_py() for k in key)
        at, row = np.unique(ask["z"].to_numpy(), return_inverse=True)
        best, which = lowest(*column(tiles, "tz", (0, 1, 2)), at, weights[0], far)
        line = (ask["y"].to_numpy() - ty * TILE) * TILE + ask["x"].to_numpy() - tx * TILE
        d = best[row, line] if len(ask) else np.empty(0, kind)
        found = d < far
        dist = np.where(found, np.sqrt(np.where(found, d, 0).astype(float)) * unit, np.nan)
        label = pa.array(np.where(found, which[row, line], 0) if len(ask) else np.empty(0, np.int64), mask=~found)
        return arrow_table(answer, **{c: ask[c] for c in (*keys, *AXES, *carry)}, dist=dist, label=label)

    n = parallelism(spark)
    named = sites.select(*keys, *AXES, (F.col("label") if "label" in sites.columns else F.lit(0)).cast("long").alias("label"))
    lines = named.select("*", tile["z"], tile["y"]).join(wanted_x, keys).repartition(n, *keys, "tz", "ty")
    first = lines.groupBy(*keys, "tz", "ty").applyInArrow(along_x, schema)
    second = first.join(wanted_y, [*keys, "tx"]).repartition(n, *keys, "tz", "tx").groupBy(*keys, "tz", "tx").applyInArrow(along_y, schema)
    tiles = second.repartition(n, *keys, "ty", "tx").groupBy(*keys, "ty", "tx")
    ask = asked.repartition(n, *keys, "ty", "tx").groupBy(*keys, "ty", "tx")
    out = tiles.cogroup(ask).applyInArrow(along_z, answer)
    return out.withColumn("dist", F.when(F.isnan("dist"), None).otherwise(F.col("dist")))
