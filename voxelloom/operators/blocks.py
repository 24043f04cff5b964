"""Block grid and halo exchange.

A block is a fixed box of the voxel lattice, so a group keyed by
``(volume_id, bz, by, bx)`` is bounded by the box size however large one
object or one volume is.  Halo copies are made by the JVM (three ``sequence``
explodes); only the kernel runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.session import parallelism

AXES = ("z", "y", "x")
BLOCK = (64, 64, 64)
TYPES = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
         "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_table(schema: str, **columns) -> pa.Table:
    """Table of a DDL schema of plain types from arrays; NaN becomes null, as on the way from pandas."""
    fields = [f.split() for f in schema.split(", ")]

    def column(values, kind):
        return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind, from_pandas=True)

    return pa.table({n: column(columns[n], TYPES.get(t)) for n, t in fields})


def with_blocks(vox: DataFrame, block=BLOCK, lo=(0, 0, 0), hi=(0, 0, 0), below_zero: bool = False, inside: bool = False) -> DataFrame:
    """Copy every row to each block whose box, grown by ``lo`` below and
    ``hi`` above, contains it.  Blocks below the origin are skipped unless
    ``below_zero``, those beyond the ends ``z1, y1, x1`` of a row if ``inside``."""
    out = vox
    for axis, size, below, above in zip(AXES, block, lo, hi):
        first = F.floor((F.col(axis) - above) / size)
        if not below_zero:
            first = F.greatest(F.lit(0), first)
        last = F.floor((F.col(axis) + below) / size)
        if inside:
            last = F.greatest(F.floor(F.col(axis) / size), F.least(last, F.floor((F.col(f"{axis}1") - 1) / size)))
        target = last if below == above == 0 else F.explode(F.sequence(first, last))
        out = out.withColumn(f"b{axis}", target)
    return out


def scatter(rows: pa.Table, column: str, origin, shape, dtype=np.int64, fill=0) -> np.ndarray:
    """Dense box of one column."""
    dense = np.full(shape, fill, dtype=dtype)
    dense[tuple(rows[a].to_numpy() - o for a, o in zip(AXES, origin))] = rows[column].to_numpy()
    return dense


def inner_origin(origin, inner) -> np.ndarray:
    """Global coordinate of the first inner voxel."""
    return origin + np.array([s.start for s in inner], dtype=np.int64)


def gather(mask: np.ndarray, origin, **columns: np.ndarray) -> dict[str, np.ndarray]:
    """Columns (global coordinates and values) of the voxels where ``mask``."""
    where = np.nonzero(mask)
    out = {a: (w + o).astype(np.int64) for a, w, o in zip(AXES, where, origin)}
    return out | {name: values[where] for name, values in columns.items()}


def map_blocks(vox: DataFrame, kernel: Callable, schema: str, columns: dict, block=BLOCK,
               lo=(0, 0, 0), hi=(0, 0, 0), meta: list[str] = (), keys: list[str] = ("volume_id",),
               boxes: DataFrame | None = None, core_only: bool = False, below_zero: bool = False, crop: bool = True,
               inside: bool = False) -> DataFrame:
    """Run ``kernel(arrays, origin, inner, meta)`` once per key and block.

    ``columns`` maps a column of ``vox`` to ``(dtype, fill)``; ``origin`` is
    the global coordinate of array index 0 and ``inner`` the slices of the
    block proper, without halo.  The kernel returns the columns of its rows without the keys,
    as a dict of arrays or a pandas frame.
    ``schema`` describes the output after the keys.  ``keys`` may add the
    label, for per-object work.  ``boxes`` (keys and ``bz, by, bx`` plus the
    meta columns) adds blocks that must be visited though no voxel is in them.
    With ``core_only`` blocks that hold halo voxels only are skipped; use it
    for kernels that return stored voxels.  Arrays are cropped to the stored
    voxels plus a rim as wide as the halo (at least one), so a thin object does
    not cost a full box; ``crop=False`` keeps the whole block.  With ``inside``
    blocks beyond the meta columns ``z1, y1, x1`` are not visited; use it where
    the kernel returns nothing outside that box.

    Blocks travel as Arrow tables: pandas frames would cost a small block more
    than its kernel does.
    """
    names, keys = list(columns), list(keys)
    nk = len(keys)
    values = [n for n in names if n not in keys]
    sparse = boxes is not None
    rim = [max(low, high, 1) for low, high in zip(lo, hi)]
    key_types = ", ".join(f"{k} {vox.schema[k].dataType.simpleString()}" for k in keys)
    full = f"{key_types}, {schema}"

    def run(key, table):
        start = np.array([k.as_py() * b for k, b in zip(key[nk:], block)], dtype=np.int64)
        stop = start + block
        extra = {m: table[m].slice(0, 1).to_numpy()[0] for m in meta}
        rows = table.filter(table["z"].is_valid()) if sparse else table
        at = [rows[a].to_numpy() for a in AXES]
        if core_only:
            core = np.ones(len(rows), dtype=bool)
            for c, s, e in zip(at, start, stop):
                core &= (c >= s) & (c < e)
            if not core.any():
                return arrow_table(full, **dict.fromkeys((f.split()[0] for f in full.split(", ")), ()))
        first, last = start - lo, stop + hi
        if crop and not sparse:
            first = np.maximum(first, [c.min() - r for c, r in zip(at, rim)])
            last = np.minimum(last, [c.max() + 1 + r for c, r in zip(at, rim)])
        shape = tuple(last - first)
        inner = tuple(slice(max(0, int(s - f)), max(0, int(min(e, g) - f))) for s, e, f, g in zip(start, stop, first, last))
        arrays = {n: scatter(rows, n, first, shape, *columns[n]) for n in names}
        out = dict(kernel(arrays, first, inner, extra).items())
        size = len(next(iter(out.values())))
        return arrow_table(full, **out, **{k: pa.repeat(v, size) for k, v in zip(keys, key)})

    rows = with_blocks(vox.select(*keys, *AXES, *values, *meta), block, lo, hi, below_zero, inside)
    if boxes is not None:
        rows = rows.unionByName(boxes.select(*keys, "bz", "by", "bx", *meta), allowMissingColumns=True)
    # A declared partition count: adaptive coalescing would pack small but compute-heavy blocks into few tasks.
    rows = rows.repartition(parallelism(vox.sparkSession), *keys, "bz", "by", "bx")
    return rows.groupBy(*keys, "bz", "by", "bx").applyInArrow(run, full)


def block_grid(volumes: DataFrame, block, min_tail: int = 0) -> DataFrame:
    """One row per block of every volume, half-open boxes clipped at the edge.

    With ``min_tail`` a last block thinner than that is merged into the one
    before it.
    """
    out = volumes
    for axis, size in zip(AXES, block):
        n = F.col(f"n{axis}")
        count = F.ceil(n / size)
        if min_tail:
            tail = n % size
            count = F.when((tail > 0) & (tail < min_tail) & (count > 1), count - 1).otherwise(count)
        out = out.withColumn(f"_c{axis}", count.cast("long"))
        out = out.withColumn(f"b{axis}", F.explode(F.sequence(F.lit(0), F.col(f"_c{axis}") - 1)))
        out = out.withColumn(f"{axis}0", (F.col(f"b{axis}") * size).cast("long"))
        out = out.withColumn(
            f"{axis}1",
            F.when(F.col(f"b{axis}") == F.col(f"_c{axis}") - 1, n).otherwise(F.col(f"{axis}0") + size).cast("long"),
        ).drop(f"_c{axis}")
    return out


def tile_grid(volumes: DataFrame, tile, halo) -> DataFrame:
    """Outer tiles around inner tiles of ``tile - 2*halo``, clipped at the edge."""
    inner = tuple(t - 2 * h for t, h in zip(tile, halo))
    out = block_grid(volumes, inner)
    for axis, h in zip(AXES, halo):
        out = out.withColumn(f"o{axis}0", F.greatest(F.lit(0), F.col(f"{axis}0") - h).cast("long"))
        out = out.withColumn(f"o{axis}1", F.least(F.col(f"n{axis}"), F.col(f"{axis}1") + h).cast("long"))
    return out


def crop_grid(volumes: DataFrame, crop, stride) -> DataFrame:
    """Overlapping crops at a stride; only crops that fit."""
    out = volumes
    for axis, size, step in zip(AXES, crop, stride):
        n = F.col(f"n{axis}")
        last = F.greatest(F.lit(0), n - size)
        out = out.withColumn(f"{axis}0", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))))
        out = out.withColumn(f"{axis}1", F.least(n, F.col(f"{axis}0") + size))
    return out


def budget_block(volumes: DataFrame, max_voxels: int) -> DataFrame:
    """Whole xy planes, as many slices as fit the voxel budget (at least one)."""
    plane = F.col("ny") * F.col("nx")
    depth = F.greatest(F.lit(1), F.least(F.col("nz"), F.floor(F.lit(max_voxels) / plane)))
    return volumes.withColumn("block_z", depth.cast("long"))
