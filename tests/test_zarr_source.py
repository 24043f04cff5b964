import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import dense
from voxelloom.sources import chunks as CH
from voxelloom.sources import stores as ST
from voxelloom.sources import zarr_source as ZS


def meta(shape, chunks, dtype="<i4", **more):
    return {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "order": "C", "fill_value": 0, "filters": None, "compressor": None} | more


def put_array(folder, a, chunk, **more):
    """A store array with one file per chunk; ``a`` with or without a channel axis."""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / ".zarray").write_text(json.dumps(meta(list(a.shape), list(chunk), a.dtype.str, **more)))
    for at in itertools.product(*[range(-(-n // c)) for n, c in zip(a.shape, chunk)]):
        box = np.zeros(chunk, a.dtype)
        part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk))]
        box[tuple(slice(0, n) for n in part.shape)] = part
        (folder / ".".join(map(str, at))).write_bytes(box.tobytes())


@pytest.fixture
def stores(tmp_path):
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 9, (5, 6, 7)).astype("<i4"), rng.integers(1, 9, (2, 4, 4, 4)).astype("<i4")
    put_array(tmp_path / "deep" / "a.zarr" / "labels" / "m", a, (2, 3, 4))
    put_array(tmp_path / "b.zarr" / "raw", b, (1, 2, 2, 2))
    return tmp_path, a, b


def whole(rows, shape):
    return dense(CH.decode(rows).withColumn("volume_id", F.lit(0)), shape)


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_scan_of_several_stores(spark, stores, size):
    root, a, b = stores
    rows = ZS.scan_zarr(spark, str(root), size)
    assert np.array_equal(whole(rows.where("key = 'labels/m'"), a.shape), a)
    for c in range(2):
        assert np.array_equal(whole(rows.where(F.col("key").isin("raw", "x") & (F.col("channel") == c)), b.shape[1:]), b[c])
    assert rows.count() == 3 * 2 * 2 + 2 * 8
    assert rows.rdd.getNumPartitions() == (28 if size == 1 else 1)


def test_only_chunks_that_are_wanted_are_opened(spark, stores):
    root, a, _ = stores
    for f in root.rglob("*"):  # every chunk outside the region is broken
        if f.is_file() and f.name != ".zarray" and not (f.parent.name == "m" and f.name.split(".")[2] == "1" and f.name.split(".")[0] in "01"):
            f.write_bytes(b"?")
    got = ZS.scan_zarr(spark, str(root), keys=["labels/m"], z=(None, 3), x=(4, 7))
    assert got.count() == 4
    want = np.zeros_like(a)
    want[:4, :, 4:] = a[:4, :, 4:]
    assert np.array_equal(whole(got, a.shape), want)
    one = ZS.scan_zarr(spark, str(root), stores=["a.zarr"], z=(2, 4), y=(0, 3), x=(6, None))
    assert [(r.z0, r.y0, r.x0) for r in one.collect()] == [(2, 0, 4)]


def test_ranges_that_leave_nothing(spark, stores):
    root, *_ = stores
    for none in ({"z": (3, 3)}, {"x": (90, None)}, {"keys": []}, {"stores": ["c.zarr"]}, {"channel": (2, None)}, {"y": (None, 0)}):
        assert ZS.scan_zarr(spark, str(root), **none).count() == 0
    with pytest.raises(TypeError):
        ZS.scan_zarr(spark, str(root), color="red")


def test_queries_on_one_scan_do_not_limit_each_other(spark, stores):
    rows = ZS.scan_zarr(spark, str(stores[0]))
    left, right = rows.where("key = 'raw' and channel = 1"), rows.where("key = 'labels/m' and z0 > 2")
    assert (left.count(), right.count(), rows.count(), left.unionByName(right).count()) == (8, 4, 28, 12)


def test_planning_lists_no_chunk_folder(stores, monkeypatch):
    root, *_ = stores
    listed, opened = [], []
    folders, read = ST._folders, ST._read
    monkeypatch.setattr(ST, "_folders", lambda uri: listed.append(uri) or folders(uri))
    monkeypatch.setattr(ST, "_read", lambda uri, *a: opened.append(uri) or read(uri, *a))
    reader = ZS.ZarrReader({"path": str(root), "wanted": json.dumps({"keys": ["raw"], "z": [2, None]})})
    (part,) = reader.partitions()
    assert sum(r[4] - r[3] for r in part.ranges) == 2 * 4
    assert not any(u.endswith(("labels/m", "b.zarr/raw")) for u in listed)
    assert all(u.rsplit("/", 1)[1] in (".zmetadata", ".zarray") for u in opened)


def test_consolidated_metadata_is_enough(spark, stores):
    root, _, b = stores
    spec = (root / "b.zarr" / "raw" / ".zarray").read_text()
    doc = {"zarr_consolidated_format": 1, "metadata": {".zattrs": {"n": 1}, "raw/.zarray": json.loads(spec)}}
    (root / "b.zarr" / ".zmetadata").write_text(json.dumps(doc))
    (root / "b.zarr" / "raw" / ".zarray").unlink()
    got = ZS.scan_zarr(spark, str(root), keys=["raw"], channel=(1, 2))
    assert np.array_equal(whole(got, b.shape[1:]), b[1])
    assert [r.attrs for r in ST.zarr_attributes(spark, str(root)).collect()] == ['{"n": 1}']
    assert sorted(r.key for r in ST.zarr_catalog(spark, str(root)).collect()) == ["labels/m", "raw"]


def test_empty_root_and_unreadable_arrays(spark, tmp_path):
    assert ZS.scan_zarr(spark, str(tmp_path)).count() == 0
    assert ST.zarr_catalog(spark, str(tmp_path / "none")).count() == 0
    folder = tmp_path / "c.zarr" / "m"
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps(meta([4, 4], [2, 2])))
    with pytest.raises(Exception, match="another rank"):
        ZS.scan_zarr(spark, str(tmp_path)).count()


def test_partitions_grow_where_there_would_be_too_many(tmp_path, monkeypatch):
    folder = tmp_path / "big.zarr" / "m"
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps(meta([1 << 20] * 3, [128] * 3, "<u8")))  # 8 EiB of fill value
    monkeypatch.setattr(ZS, "MAX_PARTITIONS", 1000)
    parts = ZS.ZarrReader({"path": str(tmp_path)}).partitions()
    assert len(parts) <= 1001 and sum(r[4] - r[3] for p in parts for r in p.ranges) == (1 << 13) ** 3
