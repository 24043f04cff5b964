"""Chunked array stores (Zarr v2) and tomograms (MRC): headers and chunks are
read in tasks, one row of the plan per chunk or slab.

The plan is an ordinary DataFrame, so a filter on the chunk corner removes
chunks before any byte is read.  Paths may be any URI that pyarrow can open.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators.joins import join_small
from voxelloom.session import cut, parallelism
from voxelloom.sources.files import guarded_copy

CHUNK = ("volume_id string, key string, z0 long, y0 long, x0 long, nz int, ny int, nx int, dtype string, data binary")


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def _read(uri: str, start: int = 0, size: int | None = None) -> bytes | None:
    system, path = _open(uri)
    try:
        with system.open_input_file(path) as f:
            f.seek(start)
            return f.read() if size is None else f.read(size)
    except FileNotFoundError:
        return None


def write_bytes(uri: str, data: bytes) -> None:
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


# ------------------------------------------------------------------ Zarr v2
def _folders(uri: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    from pyarrow import fs

    system, path = _open(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


def stores_under(root: str) -> list[str]:
    """Stores (folders named ``*.zarr``) at any depth below ``root``, which may
    be one itself; hidden folders are left out.  Nothing inside a store is listed."""
    root = root.rstrip("/")
    if root.endswith(".zarr"):
        return [root]
    return [s for name in _folders(root) if name[0] not in "._" for s in stores_under(f"{root}/{name}")]


def store_files(store: str, name: str) -> Iterator[tuple[str, str]]:
    """(key, text) of the metadata files ``name`` of a store: from consolidated
    metadata where there are any, else folder by folder.  Arrays are leaves: a
    folder with array metadata is not listed, however many chunk files it has."""
    whole = _read(f"{store}/.zmetadata")
    if whole is not None:
        for path, spec in sorted(json.loads(whole)["metadata"].items()):
            key, _, last = path.rpartition("/")
            if last == name:
                yield key, json.dumps(spec)
        return
    keys = [""]
    while keys:
        key = keys.pop()
        here = f"{store}/{key}".rstrip("/")
        array = _read(f"{here}/.zarray")
        text = array if name == ".zarray" else _read(f"{here}/{name}")
        if text is not None:
            yield key, text.decode()
        if array is None:
            keys += [f"{key}/{f}".lstrip("/") for f in _folders(here)]


def _fetch(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``volume_id, key, json`` of the metadata files of all stores, read in tasks; the driver lists stores only."""

    def load(frames):
        for pdf in frames:
            rows = [[store, *file] for store in pdf["volume_id"] for file in store_files(store, name)]
            yield pd.DataFrame(rows, columns=["volume_id", "key", "json"])

    stores = spark.createDataFrame([(s,) for s in stores_under(root)], "volume_id string")
    return stores.repartition(parallelism(spark), "volume_id").mapInPandas(load, "volume_id string, key string, json string")


def zarr_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per array of every store under ``root``.

    Arrays are (Z, Y, X), or (C, Z, Y, X) with ``sc`` channels in chunks of
    ``cc``; ``sc`` is NULL without a channel axis.  Arrays of another rank or
    with filters are listed too, but can't be planned.
    """
    spec = F.from_json("json", "shape array<long>, chunks array<long>, dtype string, compressor struct<id:string>, fill_value double, "
                               "dimension_separator string, order string, filters array<struct<id:string>>")
    found = _fetch(spark, root, ".zarray").select("volume_id", "key", spec.alias("m"))
    rank = F.size("m.shape")
    ahead = F.when(rank == 4, F.lit(1)).otherwise(F.lit(0))
    sizes = [F.get(f"m.{name}", ahead + i).alias(f"{short}{a}") for name, short in (("shape", "s"), ("chunks", "c")) for i, a in enumerate("zyx")]
    channels = [F.when(rank == 4, F.get(f"m.{name}", F.lit(0))).alias(f"{short}c") for name, short in (("shape", "s"), ("chunks", "c"))]
    return found.select(
        "volume_id", "key", *sizes, *channels, rank.alias("rank"), F.col("m.dtype").alias("dtype"), F.col("m.compressor.id").alias("codec"),
        F.coalesce("m.fill_value", F.lit(0.0)).alias("fill"), F.coalesce("m.dimension_separator", F.lit(".")).alias("separator"),
        F.coalesce("m.order", F.lit("C")).alias("order"), F.coalesce(F.size("m.filters"), F.lit(0)).alias("n_filters"))


def zarr_attributes(spark: SparkSession, root: str) -> DataFrame:
    """Attributes of stores and arrays as JSON text."""
    return _fetch(spark, root, ".zattrs").withColumnRenamed("json", "attrs")


def zarr_plan(catalog: DataFrame) -> DataFrame:
    """One row per chunk and channel: its grid index, corner and size.

    A filter on ``channel`` (0 without a channel axis) prunes like one on the
    corner.  Fails on arrays that can't be read.
    """
    known = F.col("rank").isin(3, 4) & (F.col("n_filters") == 0) & F.col("order").isin("C", "F")
    refused = F.raise_error(F.concat(F.lit("array with another rank, order or with filters: "), F.col("volume_id"), F.lit("/"), F.col("key"))).cast("long")
    out = catalog.withColumn("sz", F.when(known, F.col("sz")).otherwise(refused))
    out = out.withColumn("channel", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("sc", F.lit(1)) - 1)))
    for a in "zyx":
        last = F.floor((F.col(f"s{a}") - 1) / F.col(f"c{a}"))
        out = out.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        out = out.withColumn(f"{a}0", F.col(f"i{a}") * F.col(f"c{a}"))
        out = out.withColumn(f"n{a}", F.least(F.col(f"c{a}"), F.col(f"s{a}") - F.col(f"{a}0")).cast("int"))
    return out


def _unpack(data: bytes, codec: str | None) -> bytes:
    if codec in (None, ""):
        return data
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "gzip":
        return gzip.decompress(data)
    raise ValueError(f"chunk codec {codec} is not supported")


def chunk_bytes(r, channel: int, index: list[int], size) -> bytes:
    """C-ordered bytes of one chunk of array ``r`` (a row of the catalog), cut to
    ``size``; an absent chunk file holds the fill value."""
    many = r.rank == 4
    place = ([channel // int(r.cc)] if many else []) + index
    raw = _read("/".join(p for p in (r.volume_id, r.key, r.separator.join(str(int(i)) for i in place)) if p))
    full = ([int(r.cc)] if many else []) + [int(r.cz), int(r.cy), int(r.cx)]
    codec = None if pd.isna(r.codec) else r.codec
    box = (np.full(full, r.fill, dtype=r.dtype) if raw is None
           else np.frombuffer(_unpack(raw, codec), dtype=r.dtype).reshape(full, order=r.order))
    if many:
        box = box[channel % int(r.cc)]
    return np.ascontiguousarray(box[: size[0], : size[1], : size[2]]).tobytes()


def read_zarr(plan: DataFrame) -> DataFrame:
    """Chunk rows of the planned chunks; absent chunk files hold the fill value."""

    def load(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                data = chunk_bytes(r, int(r.channel), [r.iz, r.iy, r.ix], (r.nz, r.ny, r.nx))
                yield pd.DataFrame([[r.volume_id, r.key, r.channel, r.z0, r.y0, r.x0, r.nz, r.ny, r.nx, r.dtype, data]],
                                   columns=["volume_id", "key", "channel", "z0", "y0", "x0", "nz", "ny", "nx", "dtype", "data"])

    spread = plan.repartition(parallelism(plan.sparkSession), "volume_id", "key", "channel", "iz", "iy", "ix")
    return spread.mapInPandas(load, CHUNK.replace("key string,", "key string, channel long,"))


def chunk_file(r, block, codec: str, dtype: str) -> tuple[str, bytes]:
    """Name and content of the file of one chunk row, padded to a full block."""
    if np.dtype(r.dtype) != np.dtype(dtype):
        raise ValueError(f"chunk of {r.dtype} in an array of {dtype}")
    box = np.zeros(block, dtype=r.dtype)
    box[:r.nz, :r.ny, :r.nx] = np.frombuffer(r.data, dtype=r.dtype).reshape(r.nz, r.ny, r.nx)
    name = ".".join(str(int(o) // b) for o, b in zip((r.z0, r.y0, r.x0), block))
    return name, zlib.compress(box.tobytes()) if codec == "zlib" else box.tobytes()


def array_file(r, block, codec: str, dtype: str) -> bytes:
    """Array metadata of a row with ``nz, ny, nx``."""
    spec = {"zarr_format": 2, "shape": [int(r.nz), int(r.ny), int(r.nx)], "chunks": list(block), "dtype": np.dtype(dtype).str, "order": "C",
            "compressor": {"id": "zlib", "level": 1} if codec == "zlib" else None, "fill_value": 0, "filters": None}
    return json.dumps(spec).encode()


def write_zarr(chunks: DataFrame, volumes: DataFrame, root: str, key: str, block, codec: str = "zlib", attrs: dict | None = None,
               dtype: str = "<i8", array_attrs: dict | None = None) -> DataFrame:
    """Write chunk rows as ``<root>/<volume_id>.zarr/<key>`` and return one row
    per chunk written.  Each task writes only its own chunk files, so a retried
    task rewrites the same bytes.

    ``dtype`` is that of all chunks; a chunk of another one fails.  ``attrs``
    belong to the store, ``array_attrs`` to the array.
    """
    def put_chunk(frames):
        for pdf in frames:
            names = []
            for r in pdf.itertuples(index=False):
                name, data = chunk_file(r, block, codec, dtype)
                write_bytes(f"{root}/{r.volume_id}.zarr/{key}/{name}", data)
                names.append([str(r.volume_id), name])
            yield pd.DataFrame(names, columns=["volume_id", "chunk"])

    def put_meta(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                write_bytes(f"{root}/{r.volume_id}.zarr/{key}/.zarray", array_file(r, block, codec, dtype))
                write_bytes(f"{root}/{r.volume_id}.zarr/.zattrs", json.dumps(attrs or {}).encode())
                if array_attrs:
                    write_bytes(f"{root}/{r.volume_id}.zarr/{key}/.zattrs", json.dumps(array_attrs).encode())
            yield pd.DataFrame({"volume_id": pdf["volume_id"].astype(str), "chunk": ".zarray"})

    need = chunks.select("volume_id", "z0", "y0", "x0", "nz", "ny", "nx", "dtype", "data")
    out = "volume_id string, chunk string"
    return need.mapInPandas(put_chunk, out).unionByName(volumes.select("volume_id", "nz", "ny", "nx").mapInPandas(put_meta, out))


def copy_guarded(chunks: DataFrame, source: DataFrame, target: DataFrame, root: str, key: str, block, run: str,
                 codec: str = "zlib", dtype: str = "<i8") -> DataFrame:
    """Copy chunk rows into ``<root>/<volume_id>.zarr/<key>`` for the volumes of
    ``source`` whose shape ``target`` has too (one row per volume in each), in two
    phases; per volume of ``source``: ``volume_id, copied, chunks, bytes``.

    Tasks first stage chunk files outside the stores, each under a name of the
    attempt that is then renamed, so a repeated or speculative attempt replaces a
    whole file by the same bytes.  Only when all are staged does one task per
    volume add metadata and rename the staged folder to the array.  Until then a
    reader sees no array, and afterwards a whole one; a failed run leaves nothing
    but its staging folder, and a run repeated under the same name ``run`` starts
    over.  A volume that ``run`` has committed already stays as it is; an array of any
    other origin is never overwritten, the copy fails.  The folder rename is
    atomic on file systems where rename is.  Volumes without chunk rows become
    arrays of fill value; a volume of another or unknown shape is not copied.
    """
    fits = cut(guarded_copy(source.select("volume_id", "nz", "ny", "nx"), target, ["volume_id"]))
    need = join_small(chunks.select("volume_id", "z0", "y0", "x0", "nz", "ny", "nx", "dtype", "data"), fits.select("volume_id"), ["volume_id"],
                      "left_semi", materialise=False)
    id_type = source.schema["volume_id"].dataType.simpleString()

    def stage(frames):
        for pdf in frames:
            done = []
            for r in pdf.itertuples(index=False):
                name, data = chunk_file(r, block, codec, dtype)
                _stage(root, run, r.volume_id, name, data)
                done.append([r.volume_id, name, len(data)])
            yield pd.DataFrame(done, columns=["volume_id", "chunk", "bytes"])

    staged = cut(need.mapInPandas(stage, f"volume_id {id_type}, chunk string, bytes long"))  # all staged before any is committed
    written = staged.groupBy("volume_id", "chunk").agg(F.max("bytes").alias("bytes")).groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    ready = fits.join(written, "volume_id", "left").select("volume_id", "nz", "ny", "nx", F.coalesce("chunks", zero).alias("chunks"), F.coalesce("bytes", zero).alias("bytes"))

    def commit(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                commit_array(r, root, key, run, array_file(r, block, codec, dtype))
            yield pdf[["volume_id", "chunks", "bytes"]]

    copied = cut(ready.mapInPandas(commit, f"volume_id {id_type}, chunks long, bytes long"))
    return source.select("volume_id").join(copied, "volume_id", "left").select(
        "volume_id", F.col("chunks").isNotNull().alias("copied"), F.coalesce("chunks", zero).alias("chunks"), F.coalesce("bytes", zero).alias("bytes"))


def _staged(root: str, run: str, volume) -> str:
    return f"{root}/.copy-{run}/{volume}"


def _stage(root: str, run: str, volume, name: str, data: bytes) -> None:
    """Write a file aside and rename it into the staged folder, so that it is whole there at any time."""
    own, uri = f"{_staged(root, run, '.attempts')}/{uuid.uuid4().hex}", f"{_staged(root, run, volume)}/{name}"
    write_bytes(own, data)
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    system.move(_open(own)[1], path)


def commit_array(r, root: str, key: str, run: str, meta: bytes) -> None:
    """Rename the staged folder of volume ``r`` to its array, once per run."""
    from pyarrow import fs

    final, origin = f"{root}/{r.volume_id}.zarr/{key}", {"copied_by": run, "chunks": int(r.chunks), "bytes": int(r.bytes)}
    system, path = _open(final)
    folder = _open(_staged(root, run, r.volume_id))[1]

    def committed() -> bool:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return False
        if json.loads(_read(f"{final}/.zattrs") or b"{}").get("copied_by") != run:
            raise FileExistsError(f"{final} exists and is not of this copy")
        return True

    if committed():
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)  # staged once more by a repeated run
        return
    _stage(root, run, r.volume_id, ".zattrs", json.dumps(origin).encode())
    _stage(root, run, r.volume_id, ".zarray", meta)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    try:
        system.move(folder, path)
    except OSError:
        if not committed():  # another attempt may have been quicker
            raise


# ------------------------------------------------------------------ MRC
# MRC mode numbers and the header length in bytes.
MRC_MODES = {0: "<i1", 1: "<i2", 2: "<f4", 6: "<u2", 12: "<f2"}
MRC_HEADER = 1024


def mrc_catalog(manifest: DataFrame) -> DataFrame:
    """Shape, dtype, payload offset and voxel size (nm, zyx) from the headers."""

    def heads(frames):
        for pdf in frames:
            rows = []
            for path in pdf["path"]:
                head = _read(path, 0, MRC_HEADER)
                nx, ny, nz, mode = np.frombuffer(head, "<i4", 4)
                mx, my, mz = np.frombuffer(head, "<i4", 3, 28)
                cell = np.frombuffer(head, "<f4", 3, 40)
                extra = int(np.frombuffer(head, "<i4", 1, 92)[0])
                size = [float(c) / int(m) / 10 if m else None for c, m in zip(cell, (mx, my, mz))]
                rows.append([path, int(nz), int(ny), int(nx), MRC_MODES[int(mode)], MRC_HEADER + extra, *size[::-1]])
            yield pd.DataFrame(rows, columns=["volume_id", "nz", "ny", "nx", "dtype", "start", "nm_z", "nm_y", "nm_x"])

    return manifest.select("path").mapInPandas(
        heads, "volume_id string, nz long, ny long, nx long, dtype string, start long, nm_z double, nm_y double, nm_x double")


def read_mrc(catalog: DataFrame, slices: int = 8) -> DataFrame:
    """Chunk rows of ``slices`` whole z-slices each, read by offset."""
    slabs = catalog.withColumn("z0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nz") - 1, F.lit(slices).cast("long"))))
    slabs = slabs.withColumn("dz", F.least(F.lit(slices), F.col("nz") - F.col("z0")))

    def load(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                plane = r.ny * r.nx * np.dtype(r.dtype).itemsize
                data = _read(r.volume_id, int(r.start + r.z0 * plane), int(r.dz * plane))
                yield pd.DataFrame([[r.volume_id, "data", r.z0, 0, 0, r.dz, r.ny, r.nx, r.dtype, data]],
                                   columns=["volume_id", "key", "z0", "y0", "x0", "nz", "ny", "nx", "dtype", "data"])

    return slabs.repartition(parallelism(catalog.sparkSession), "volume_id", "z0").mapInPandas(load, CHUNK)
