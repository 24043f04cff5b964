"""Voxel rows to dense chunk rows and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import AXES, BLOCK, map_blocks
from voxelloom.operators.joins import join_small

CHUNK_SCHEMA = ("volume_id string, key string, cz int, cy int, cx int, z0 long, y0 long, x0 long, "
                "nz int, ny int, nx int, dtype string, data binary")


def encode(vox: DataFrame, value: str, volumes: DataFrame, dtype: str = "<i8", block=BLOCK) -> DataFrame:
    """Dense blocks from voxel rows, missing voxels 0, clipped to the volume."""

    def kernel(arrays, origin, inner, meta):
        box = arrays[value]
        size = [int(min(b, meta[f"n{a}"] - o)) for a, b, o in zip(AXES, box.shape, origin)]
        data = np.ascontiguousarray(box[:size[0], :size[1], :size[2]]).astype(dtype).tobytes()
        row = {f"{a}0": [int(o)] for a, o in zip(AXES, origin)}
        row.update({f"n{a}": [s] for a, s in zip(AXES, size)})
        return pd.DataFrame({**row, "dtype": [dtype], "data": [data]})

    rows = join_small(vox.select("volume_id", *AXES, value), volumes.select("volume_id", "nz", "ny", "nx"), ["volume_id"], materialise=False)
    return map_blocks(rows, kernel, "z0 long, y0 long, x0 long, nz long, ny long, nx long, dtype string, data binary",
                      {value: (np.dtype(dtype).newbyteorder("=").type, 0)}, block, meta=["nz", "ny", "nx"], crop=False)


def decode(chunks: DataFrame, value: str = "label", foreground_only: bool = True, kind: str = "long") -> DataFrame:
    """Voxel rows of binary chunks; one Arrow batch of chunks at a time.

    Chunks of fractions need ``kind="double"``: they fail as whole numbers.
    """
    key_type = chunks.schema["volume_id"].dataType.simpleString()

    def read(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                box = np.frombuffer(r.data, dtype=r.dtype).reshape(r.nz, r.ny, r.nx)
                if kind == "long" and box.dtype.kind == "f":
                    raise ValueError(f"chunks of {r.dtype} hold fractions, decode them with kind='double'")
                at = np.nonzero(box) if foreground_only else np.unravel_index(np.arange(box.size), box.shape)
                out = {a: (w + o).astype(np.int64) for a, w, o in zip(AXES, at, (r.z0, r.y0, r.x0))}
                yield pd.DataFrame({"volume_id": r.volume_id, **out, value: box[at].astype(np.int64 if kind == "long" else np.float64)})

    need = chunks.select("volume_id", "z0", "y0", "x0", "nz", "ny", "nx", "dtype", "data")
    return need.mapInPandas(read, f"volume_id {key_type}, z long, y long, x long, {value} {kind}")


def prune(chunks: DataFrame, z=(None, None), y=(None, None), x=(None, None)) -> DataFrame:
    """Chunks that meet the half-open ranges; a plain filter, so it reaches the scan."""
    out = chunks
    for a, (lo, hi) in zip(AXES, (z, y, x)):
        if lo is not None:
            out = out.where(F.col(f"{a}0") + F.col(f"n{a}") > lo)
        if hi is not None:
            out = out.where(F.col(f"{a}0") < hi)
    return out


def export(vox: DataFrame, value: str, volumes: DataFrame, path: str, key: str, factor: int = 1, block=BLOCK, dtype: str = "<i8") -> None:
    """Chunk table as Parquet, one folder per volume and key, optionally strided."""
    from voxelloom.operators.resample import stride

    rows, shape = vox.select("volume_id", *AXES, value), volumes
    if factor > 1:
        rows = stride(rows, (factor,) * 3)
        shape = volumes.select("volume_id", *[F.ceil(F.col(f"n{a}") / factor).alias(f"n{a}") for a in AXES])
    encode(rows, value, shape, dtype, block).withColumn("key", F.lit(key)).write.mode("append").partitionBy("volume_id", "key").parquet(path)
