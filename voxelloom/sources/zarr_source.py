"""Chunked array stores as a data source: ``spark.read.format("zarr_chunks")``.

A row is one chunk and channel.  The options say what is wanted (``Wanted``): only
the stores, arrays and chunks they leave are opened.  They are options and not
pushed filters because Spark (4.1) keeps the filters pushed to a Python source
with the DataFrame, so that a second query on it would miss rows.  Planning
reads metadata, never a chunk file or a folder of them, and its memory grows
with arrays and partitions, not with chunks: what is wanted of an array is a
box of the chunk grid, and a partition holds ranges of numbers within such boxes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import prod
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from voxelloom.sources.stores import chunk_bytes, store_files, stores_under

NAME = "zarr_chunks"
SCHEMA = ("volume_id string, key string, channel long, z0 long, y0 long, x0 long, "
          "nz int, ny int, nx int, dtype string, data binary")
#: Raw bytes of a partition, and partitions of a scan beyond which they get larger instead.
TARGET_BYTES, MAX_PARTITIONS = 64 << 20, 20_000
READERS = 16  # threads that fetch metadata while planning
ANY = (None, None)


@dataclass
class Part(D.InputPartition):
    """Ranges ``(array, low and high corner of its box of the chunk grid, first number, last number + 1)``."""

    ranges: list


def array_of(store: str, key: str, text: str) -> SimpleNamespace:
    """What reading the chunks of an array needs to know; fails on arrays that can't be read."""
    m = json.loads(text)
    rank, order = len(m["shape"]), m.get("order", "C")
    if rank not in (3, 4) or m.get("filters") or order not in ("C", "F"):
        raise ValueError(f"array with another rank, order or with filters: {store}/{key}")
    ahead, fill = rank - 3, m.get("fill_value")
    out = SimpleNamespace(volume_id=store, key=key, rank=rank, order=order, dtype=m["dtype"], codec=(m.get("compressor") or {}).get("id"),
                          fill=0 if fill is None else float(fill) if isinstance(fill, str) else fill,
                          separator=m.get("dimension_separator", "."), shape=m["shape"][ahead:], chunk=m["chunks"][ahead:],
                          channels=m["shape"][0] if ahead else 1, cc=m["chunks"][0] if ahead else 1)
    out.cz, out.cy, out.cx = out.chunk
    return out


@dataclass
class Wanted:
    """Stores by name (the last part of their path), arrays by key, and half-open
    ranges of channels and voxels; None leaves a side open.  Chunks that meet a
    voxel range are wanted as a whole."""

    stores: Sequence[str] | None = None
    keys: Sequence[str] | None = None
    channel: Sequence[int | None] = ANY
    z: Sequence[int | None] = ANY
    y: Sequence[int | None] = ANY
    x: Sequence[int | None] = ANY

    def box(self, array) -> tuple[list[int], list[int]]:
        """Low and (exclusive) high corner, channel first, of the wanted part of the chunk grid of an array."""
        low, high = [], []
        for (lo, hi), size, step in zip((self.channel, self.z, self.y, self.x), [array.channels, *array.shape], [1, *array.chunk]):
            lo, hi = max(0, lo or 0), size if hi is None else min(size, hi)
            low.append(lo // step)
            high.append(-(-hi // step) if hi > lo else lo // step)
        return low, high


class ZarrReader(D.DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.target = int(options.get("partitionbytes", TARGET_BYTES))
        self.wanted = Wanted(**json.loads(options.get("wanted", "{}")))

    def arrays(self) -> Iterator[SimpleNamespace]:
        stores, keys = self.wanted.stores, self.wanted.keys
        stores = [s for s in stores_under(self.root) if stores is None or s.rsplit("/", 1)[-1] in stores]
        with ThreadPoolExecutor(READERS) as pool:
            for store, files in zip(stores, pool.map(lambda s: list(store_files(s, ".zarray")), stores)):
                yield from (array_of(store, key, text) for key, text in files if keys is None or key in keys)

    def partitions(self) -> list[Part]:
        boxes = []
        for array in self.arrays():
            low, high = self.wanted.box(array)
            n = prod(max(0, h - s) for s, h in zip(low, high))
            if n:
                boxes.append((array, low, high, n, prod(array.chunk) * np.dtype(array.dtype).itemsize))
        total = sum(n * size for *_, n, size in boxes)
        target = max(self.target, -(-total // MAX_PARTITIONS))
        parts, ranges, room = [], [], target
        for array, low, high, n, size in boxes:
            at = 0
            while at < n:
                end = min(n, at + max(1, room // size))
                ranges.append((array, low, high, at, end))
                room -= (end - at) * size
                at = end
                if room < size:
                    parts.append(Part(ranges))
                    ranges, room = [], target
        return parts + [Part(ranges)] if ranges or not parts else parts  # at least one, or Spark plans one without ranges

    def read(self, partition: Part):
        import pyarrow as pa

        names = ("volume_id", "key", "channel", "z0", "y0", "x0", "nz", "ny", "nx", "dtype", "data")
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 4, *[pa.int32()] * 3, pa.string(), pa.binary())
        schema = pa.schema(list(zip(names, kinds)))
        for array, low, high, first, last in partition.ranges:
            sides = [h - s for s, h in zip(low, high)]
            for number in range(first, last):
                channel, *index = (int(i) + s for i, s in zip(np.unravel_index(number, sides), low))
                start = [i * c for i, c in zip(index, array.chunk)]
                size = [min(c, n - s) for s, c, n in zip(start, array.chunk, array.shape)]
                row = (array.volume_id, array.key, channel, *start, *size, array.dtype, chunk_bytes(array, channel, index, size))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], schema=schema)


class ZarrSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZarrReader:
        return ZarrReader(self.options)


def scan_zarr(spark: SparkSession, root: str, partition_bytes: int = TARGET_BYTES, **wanted) -> DataFrame:
    """Chunk rows of the stores below ``root``, of the parts named by the fields
    of ``Wanted``.  A root without stores gives no rows; planned arrays that
    can't be read fail."""
    spark.dataSource.register(ZarrSource)
    Wanted(**wanted)  # an unknown field fails here
    return spark.read.format(NAME).option("partitionbytes", partition_bytes).option("wanted", json.dumps(wanted)).load(root)
