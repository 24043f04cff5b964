import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import dense
from voxelloom.sources import chunks as CH
from voxelloom.sources import files as FI
from voxelloom.sources import stores as ST


def test_chunks_round_trip(frame, shapes):
    a = np.random.default_rng(0).integers(0, 5, (5, 7, 9))
    parts = CH.encode(frame(a), "label", shapes(a), block=(2, 4, 4))
    assert np.array_equal(dense(CH.decode(parts), a.shape), a)
    few = CH.prune(parts, z=(4, None))
    assert few.select("z0").distinct().collect()[0][0] == 4


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.mark.parametrize("codec", [None, "gzip"])
def test_zarr_with_a_missing_chunk(spark, tmp_path, codec):
    a = np.arange(1, 61, dtype="<u2").reshape(3, 4, 5)
    meta = {"zarr_format": 2, "shape": [3, 4, 5], "chunks": [2, 4, 3], "dtype": "<u2", "order": "C", "fill_value": 0, "filters": None,
            "compressor": {"id": codec} if codec else None}
    store = tmp_path / "v.zarr"
    put(store, "labels/m/.zarray", json.dumps(meta).encode())
    put(store, ".zattrs", b'{"voxel_size": [1, 2, 3]}')
    for z in range(2):
        for x in range(2):
            if (z, x) == (1, 1):
                a[2:, :, 3:] = 0
                continue
            box = np.zeros((2, 4, 3), "<u2")
            part = a[2 * z:2 * z + 2, :, 3 * x:3 * x + 3]
            box[:part.shape[0], :, :part.shape[2]] = part
            put(store, f"labels/m/{z}.0.{x}", gzip.compress(box.tobytes()) if codec else box.tobytes())
    catalog = ST.zarr_catalog(spark, str(tmp_path))
    assert catalog.first().key == "labels/m"
    out = CH.decode(ST.read_zarr(ST.zarr_plan(catalog))).withColumn("volume_id", F.lit(0))
    assert np.array_equal(dense(out, a.shape), a)
    assert ST.zarr_attributes(spark, str(tmp_path)).where("key = ''").count() == 1


def test_manifest_counts_a_store_once(spark, tmp_path):
    for name in ("a.zarr/x/0.0.0", "a.zarr/x/0.0.1", "b.h5"):
        put(tmp_path, name, b"1")
    assert [r.path.rsplit("/", 1)[1] for r in FI.manifest(spark, str(tmp_path)).orderBy("path").collect()] == ["a.zarr", "b.h5"]


def test_mrc_header_and_slabs(spark, tmp_path):
    a = np.arange(24, dtype="<f4").reshape(4, 2, 3)
    head = np.zeros(256, "<i4")
    head[:4] = (3, 2, 4, 2)
    head[7:10] = (3, 2, 4)
    head[10:13] = np.array([30, 40, 200], "<f4").view("<i4")
    head[23] = 8
    put(tmp_path, "t.mrc", head.tobytes() + b"\0" * 8 + a.tobytes())
    catalog = ST.mrc_catalog(FI.manifest(spark, str(tmp_path), "*.mrc"))
    r = catalog.first()
    assert (r.nz, r.ny, r.nx, r.nm_z, r.nm_y, r.nm_x) == (4, 2, 3, 5.0, 2.0, 1.0)
    out = CH.decode(ST.read_mrc(catalog, 3), "v", kind="double").withColumn("volume_id", F.lit(0))
    assert np.array_equal(dense(out, a.shape, "v", dtype=np.float32), a)


def test_split_document(spark, tmp_path):
    put(tmp_path, "s.json", json.dumps({"train": ["a", "b"], "val": ["c"], "test": []}, indent=1).encode())
    assert sorted(map(tuple, FI.read_split(spark, str(tmp_path / "s.json")).collect())) == [("a", "train"), ("b", "train"), ("c", "val")]


def test_significant_rounding(spark):
    df = spark.createDataFrame([(0.0,), (0.012345678912345,), (123456.7891234,)], "v double")
    got = [r.r for r in df.select(FI.round_significant(F.col("v")).alias("r")).collect()]
    assert got == pytest.approx([0.0, 0.01234567891, 123456.7891], rel=1e-13)


def test_multiscale_document_is_ordered(spark):
    rows = [("p/a.zarr", "p", f"s{i}", [64 >> i, 64 >> i, 64 >> i], [1.0, 2.0, 3.0] if i == 0 else None) for i in (2, 0, 1)]
    rows += [("p/b.zarr", "p", "s0", [64, 64, 64], None)]
    lv = spark.createDataFrame(rows, "store string, parent string, level string, shape array<long>, voxel_size array<double>")
    docs = {r.store: json.loads(r.attrs)["multiscales"][0] for r in FI.multiscale_document(FI.repair_multiscale(lv, [9.0, 9.0, 9.0])).collect()}
    assert [d["path"] for d in docs["p/a.zarr"]["datasets"]] == ["s0", "s1", "s2"]
    assert docs["p/a.zarr"]["datasets"][2]["coordinateTransformations"][0]["scale"] == [4.0, 8.0, 12.0]
    assert docs["p/b.zarr"]["datasets"][0]["coordinateTransformations"][0]["scale"] == [1.0, 2.0, 3.0]


def array_meta(shape, chunks, dtype, **more):
    spec = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "order": "C", "fill_value": 0, "filters": None, "compressor": None}
    return json.dumps(spec | more).encode()


def test_column_order_chunks(spark, tmp_path):
    a = np.arange(1, 25, dtype="<i4").reshape(2, 3, 4)
    put(tmp_path / "v.zarr", "m/.zarray", array_meta([2, 3, 4], [2, 3, 4], "<i4", order="F"))
    put(tmp_path / "v.zarr", "m/0.0.0", a.tobytes(order="F"))
    out = CH.decode(ST.read_zarr(ST.zarr_plan(ST.zarr_catalog(spark, str(tmp_path))))).withColumn("volume_id", F.lit(0))
    assert np.array_equal(dense(out, a.shape), a)


@pytest.mark.parametrize("per_chunk", [1, 2])
def test_channel_axis(spark, tmp_path, per_chunk):
    a = np.arange(1, 37, dtype="<f4").reshape(3, 2, 2, 3)
    put(tmp_path / "v.zarr", "m/.zarray", array_meta([3, 2, 2, 3], [per_chunk, 2, 2, 3], "<f4"))
    for c in range(0, 3, per_chunk):
        box = np.zeros((per_chunk, 2, 2, 3), "<f4")
        box[:len(a[c:c + per_chunk])] = a[c:c + per_chunk]
        put(tmp_path / "v.zarr", f"m/{c // per_chunk}.0.0.0", box.tobytes())
    plan = ST.zarr_plan(ST.zarr_catalog(spark, str(tmp_path)))
    assert plan.count() == 3
    for c in range(3):
        out = CH.decode(ST.read_zarr(plan.where(F.col("channel") == c)), "v", kind="double").withColumn("volume_id", F.lit(0))
        assert np.array_equal(dense(out, a.shape[1:], "v", dtype=np.float32), a[c])


def test_arrays_that_cannot_be_read_fail(spark, tmp_path):
    put(tmp_path / "v.zarr", "m/.zarray", array_meta([4], [4], "<i4"))
    put(tmp_path / "v.zarr", "m/0", np.arange(4, dtype="<i4").tobytes())
    put(tmp_path / "w.zarr", "m/.zarray", array_meta([1, 1, 1], [1, 1, 1], "<i4", filters=[{"id": "delta"}]))
    put(tmp_path / "w.zarr", "m/0.0.0", np.arange(1, dtype="<i4").tobytes())
    for name in ("v.zarr", "w.zarr"):
        with pytest.raises(Exception, match="another rank, order or with filters"):
            ST.zarr_plan(ST.zarr_catalog(spark, str(tmp_path)).where(F.col("volume_id").endswith(name))).collect()


def test_written_type_and_attributes(frame, shapes, spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 300, (3, 4, 5))
    parts = CH.encode(frame(a), "label", shapes(a), "<i2", block=(2, 4, 4))
    ST.write_zarr(parts, shapes(a), str(tmp_path), "m", (2, 4, 4), dtype="<i2", array_attrs={"unit": "nm"}).collect()
    catalog = ST.zarr_catalog(spark, str(tmp_path))
    assert catalog.first().dtype == "<i2"
    out = CH.decode(ST.read_zarr(ST.zarr_plan(catalog))).withColumn("volume_id", F.lit(0))
    assert np.array_equal(dense(out, a.shape), a)
    assert json.loads(ST.zarr_attributes(spark, str(tmp_path)).where("key = 'm'").first().attrs) == {"unit": "nm"}
    with pytest.raises(Exception, match="in an array of"):
        ST.write_zarr(parts, shapes(a), str(tmp_path), "n", (2, 4, 4)).collect()


def test_fractions_are_not_decoded_as_whole_numbers(frame, shapes):
    a = np.array([[[0.0, 0.25, 0.75]]])
    parts = CH.encode(frame(a, kind="double", name="p"), "p", shapes(a), "<f4", block=(1, 1, 3))
    assert sorted(r.p for r in CH.decode(parts, "p", kind="double").collect()) == [0.25, 0.75]
    with pytest.raises(Exception, match="hold fractions"):
        CH.decode(parts, "p").collect()


def test_manifest_by_extension(spark, tmp_path):
    for name in ("a.zarr/x/0.0.0", "c.zarr/x.h5/0", "b.h5"):
        put(tmp_path, name, b"1")
    names = [sorted(r.path.rsplit("/", 1)[1] for r in FI.manifest(spark, str(tmp_path), g).collect()) for g in ("*.zarr", "*.h5")]
    assert names == [["a.zarr", "c.zarr"], ["b.h5"]]


def read_back(spark, root, shape, volume):
    rows = CH.decode(ST.read_zarr(ST.zarr_plan(ST.zarr_catalog(spark, str(root)))))
    number = F.regexp_extract("volume_id", r"(\d+)\.zarr", 1).cast("long")
    return dense(rows.withColumn("volume_id", number), shape, volume=volume)


def test_copy_takes_equal_shapes_only(spark, tmp_path, frame, shapes):
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(0, 4, (5, 6, 7)), rng.integers(1, 4, (4, 4, 4)), np.zeros((3, 3, 3), int)
    parts = CH.encode(frame(a, b, c), "label", shapes(a, b, c), block=(2, 4, 4))
    guard = shapes(a, np.zeros((4, 4, 5)), c)
    out = ST.copy_guarded(parts, shapes(a, b, c), guard, str(tmp_path), "labels/m", (2, 4, 4), "r1")
    got = {r.volume_id: (r.copied, r.chunks) for r in out.collect()}
    assert got == {0: (True, 12), 1: (False, 0), 2: (True, 0)}
    assert np.array_equal(read_back(spark, tmp_path, a.shape, 0), a)
    assert not (tmp_path / "1.zarr").exists()
    assert json.loads((tmp_path / "2.zarr/labels/m/.zarray").read_text())["shape"] == [3, 3, 3]
    # the same run again changes nothing, another one does not overwrite
    before = (tmp_path / "0.zarr/labels/m/0.0.0").stat().st_mtime_ns
    again = ST.copy_guarded(parts, shapes(a, b, c), guard, str(tmp_path), "labels/m", (2, 4, 4), "r1")
    assert {r.volume_id: (r.copied, r.chunks) for r in again.collect()} == got
    assert (tmp_path / "0.zarr/labels/m/0.0.0").stat().st_mtime_ns == before
    assert not (tmp_path / ".copy-r1/0").exists()
    with pytest.raises(Exception, match="not of this copy"):
        ST.copy_guarded(parts, shapes(a, b, c), guard, str(tmp_path), "labels/m", (2, 4, 4), "r2")


def test_failed_copy_leaves_no_array(spark, tmp_path, frame, shapes):
    a = np.random.default_rng(2).integers(0, 4, (6, 6, 6))
    parts = CH.encode(frame(a), "label", shapes(a), block=(2, 4, 4))
    broken = parts.withColumn("dtype", F.when(F.col("z0") == 4, "<f8").otherwise(F.col("dtype")))
    with pytest.raises(Exception, match="chunk of <f8"):
        ST.copy_guarded(broken, shapes(a), shapes(a), str(tmp_path), "labels/m", (2, 4, 4), "r1")
    assert not (tmp_path / "0.zarr").exists()
    ST.copy_guarded(parts, shapes(a), shapes(a), str(tmp_path), "labels/m", (2, 4, 4), "r1")
    assert np.array_equal(read_back(spark, tmp_path, a.shape, 0), a)
    assert not [p for p in (tmp_path / "0.zarr/labels/m").iterdir() if len(p.name) > 8]  # no file of an attempt


def test_commit_survives_a_lost_attempt(tmp_path):
    from types import SimpleNamespace

    row = SimpleNamespace(volume_id=7, nz=2, ny=2, nx=2, chunks=1, bytes=3)
    ST._stage(str(tmp_path), "r", 7, "0.0.0", b"abc")
    meta = ST.array_file(row, (2, 2, 2), "zlib", "<i8")
    for _ in range(2):  # the second attempt finds the array in place
        ST.commit_array(row, str(tmp_path), "m", "r", meta)
    assert (tmp_path / "7.zarr/m/0.0.0").read_bytes() == b"abc"
