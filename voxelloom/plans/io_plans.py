"""Source, sink and streaming queries.

Each one stages data that Spark derives from the given tables in the shared
folder and reads it back through the source under test.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelloom.fixtures import FILES, GRID, VOX
from voxelloom.plans.measure import SMALL_BLOCK, rounded
from voxelloom.plans.registry import query
from voxelloom.session import shared_dir
from voxelloom.sources import chunks as CH
from voxelloom.sources import files as FI
from voxelloom.sources import stores as ST
from voxelloom.sources import zarr_source as ZS
from voxelloom.streaming import jobs as J

VK = ["volume_id", "z", "y", "x"]


def staging(t, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def drain(df) -> None:
    """Run a writing plan; only its row count reaches the driver."""
    df.agg(F.count(F.lit(1))).collect()


@query("src_1_manifest", f"{VOX} SELECT volume_id || '.zarr' AS name, true AS has_data FROM vol")
def _(t):
    files = FI.manifest(t.spark, zarr_store(t), "*.zarr")
    return files.select(F.substring_index("path", "/", -1).alias("name"), (F.col("length") > 0).alias("has_data"))


def zarr_store(t):
    root = staging(t, "zarr")
    parts = CH.encode(t.labels("gt"), "label", t.volumes, "<i8", SMALL_BLOCK)
    drain(ST.write_zarr(parts, t.volumes, root, "labels/mitochondria", SMALL_BLOCK, attrs={"voxel_size": [5.0, 5.0, 25.0], "axes": "xyz"}))
    return root


def volume_number(column="volume_id"):
    return F.regexp_extract(column, r"(\d+)\.zarr", 1).cast("long")


@query("src_2_zarr_scan", f"{VOX} SELECT volume_id, z, y, x, gt AS label FROM vox WHERE gt>0")
def _(t):
    plan = ST.zarr_plan(ST.zarr_catalog(t.spark, zarr_store(t)))
    return CH.decode(ST.read_zarr(plan)).withColumn("volume_id", volume_number())


@query("src_2_zarr_pruned", f"{VOX} SELECT volume_id, z, y, x, gt AS label FROM vox WHERE gt>0 AND x>=16")
def _(t):
    return CH.decode(ZS.scan_zarr(t.spark, zarr_store(t), keys=["labels/mitochondria"], x=(16, None))).withColumn("volume_id", volume_number())


@query("src_3_mrc_scan", f"{VOX} SELECT volume_id, z, count(*) n, sum(raw)::BIGINT total, 1.0::DOUBLE nm_z FROM vox WHERE raw>0 GROUP BY 1,2")
def _(t):
    root = staging(t, "mrc")
    slabs = CH.encode(t.vox, "raw", t.volumes, "<i2", (2, 64, 64))

    def put(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                head = np.zeros(256, "<i4")
                head[:4] = (r.nx, r.ny, r.nz, 1)
                head[7:10] = (r.nx, r.ny, r.nz)
                head[10:13] = np.array([r.nx * 10, r.ny * 10, r.nz * 10], "<f4").view("<i4")
                ST.write_bytes(f"{root}/v{r.volume_id}_z{r.z0}.mrc", head.tobytes() + r.data)
            yield pd.DataFrame({"n": [len(pdf)]})

    drain(slabs.mapInPandas(put, "n long"))
    catalog = ST.mrc_catalog(FI.manifest(t.spark, root, "*.mrc"))
    vox = CH.decode(ST.read_mrc(catalog, 1), "raw").join(catalog.select("volume_id", F.round("nm_z", 6).alias("nm_z")), "volume_id")
    name = F.col("volume_id")
    return vox.select(F.regexp_extract(name, r"v(\d+)_z", 1).cast("long").alias("volume_id"),
                      (F.col("z") + F.regexp_extract(name, r"_z(\d+)\.mrc", 1).cast("long")).alias("z"), "raw", "nm_z").groupBy(
        "volume_id", "z", "nm_z").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total"))


@query("src_4_score_csv", GRID + " SELECT dataset, f1_score, sbd_score FROM grid")
def _(t):
    path = staging(t, "csv")
    t.grid.select("dataset", "f1_score", "sbd_score").write.option("header", "true").csv(path)
    return FI.read_table(t.spark, path, "dataset string, f1_score double, sbd_score double")


@query("src_5_padded_csv", """SELECT p_name AS sample, p_brand AS genotype, 'h5' AS "format" FROM part UNION ALL SELECT p_name, p_brand, 'tif' FROM part WHERE p_partkey%2=0""")
def _(t):
    path = staging(t, "padded")
    formats = F.when(F.col("p_partkey") % 2 == 0, "h5;tif").otherwise("h5")
    t.table("part").select(*[F.rpad(c, 30, " ").alias(n) for c, n in (("p_name", "sample"), ("p_brand", "genotype"))],
                           F.rpad(formats, 12, " ").alias("formats")).write.option("header", "true").option(
        "ignoreTrailingWhiteSpace", "false").csv(path)
    return FI.read_padded(t.spark, path, ["formats"]).select("sample", "genotype", F.explode("formats").alias("format"))


@query("src_6_split_json", f"{FILES} SELECT path, CASE file_id%10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END split FROM files")
def _(t):
    path = staging(t, "split")
    side = F.expr("case file_id%10 when 0 then 'val' when 1 then 'test' else 'train' end")
    docs = t.files.withColumn("s", side).groupBy(F.expr("file_id div 100")).agg(
        *[F.collect_list(F.when(F.col("s") == s, F.col("path"))).alias(s) for s in ("train", "val", "test")])  # at most 100 paths a document
    docs.select("train", "val", "test").write.json(path)
    return FI.read_split(t.spark, path, multi_line=False)


@query("src_7_key_catalog", f"{VOX} SELECT volume_id, 'labels/mitochondria' AS key, nz sz, ny sy, nx sx, '<i8' AS dtype FROM vol")
def _(t):
    return ST.zarr_catalog(t.spark, zarr_store(t)).select(volume_number().alias("volume_id"), "key", "sz", "sy", "sx", "dtype")


@query("src_7_attributes", f"{VOX} SELECT volume_id, 5.0::DOUBLE first_size, 'xyz' AS axes FROM vol")
def _(t):
    attrs = ST.zarr_attributes(t.spark, zarr_store(t)).where("key = ''")
    spec = F.from_json("attrs", "voxel_size array<double>, axes string").alias("a")
    return attrs.select(volume_number().alias("volume_id"), spec).select("volume_id", F.col("a.voxel_size")[0].alias("first_size"), "a.axes")


@query("src_8_voxel_size", """SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN p_size WHEN 1 THEN p_size+2 WHEN 2 THEN p_size+12 ELSE 1 END::DOUBLE z, CASE p_partkey%4 WHEN 0 THEN p_size+1 WHEN 1 THEN p_size+1 WHEN 2 THEN p_size+11 ELSE 2 END::DOUBLE y,
  CASE p_partkey%4 WHEN 0 THEN p_size+2 WHEN 1 THEN p_size WHEN 2 THEN p_size+10 ELSE 3 END::DOUBLE x FROM part""")
def _(t):
    attrs = t.table("part").selectExpr(
        "p_partkey", "case when p_partkey%4<2 then array(double(p_size),double(p_size+1),double(p_size+2)) end d",
        "case when p_partkey%4=2 then array(double(p_size+10),double(p_size+11),double(p_size+12)) end r",
        "case when p_partkey%4=0 then 'z,y,x' when p_partkey%4=1 then 'x,y,z' end o", "cast(null as string) ro")
    size = FI.resolve_voxel_size(*[F.col(c) for c in ("d", "r", "o", "ro")], F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return attrs.select("p_partkey", size.alias("s")).select("p_partkey", *[F.col("s")[i].alias(a) for i, a in enumerate("zyx")])


@query("src_9_export", f"{VOX} SELECT volume_id, z//2 z, y//2 y, x//2 x, gt AS label FROM vox WHERE gt>0 AND z%2=0 AND y%2=0 AND x%2=0")
def _(t):
    path = staging(t, "export")
    CH.export(t.labels("gt"), "label", t.volumes, path, "gt", factor=2, block=SMALL_BLOCK)
    return CH.decode(t.spark.read.parquet(path).withColumn("volume_id", F.col("volume_id").cast("long")))


@query("src_10_chunk_decode", f"{VOX} SELECT volume_id, z, y, x, pred AS label FROM vox WHERE pred>0")
def _(t):
    return CH.decode(CH.encode(t.labels("pred"), "label", t.volumes, block=SMALL_BLOCK))


@query("src_11_chunk_encode", f"{VOX} SELECT volume_id, (z//4)*4 z0, (y//32)*32 y0, (x//16)*16 x0, count(*) n, sum(raw)::BIGINT total FROM vox WHERE raw>0 GROUP BY 1,2,3,4")
def _(t):
    parts = CH.encode(t.vox, "raw", t.volumes, block=SMALL_BLOCK)
    vox = CH.decode(parts, "raw")
    corner = [(F.floor(F.col(a) / b) * b).alias(f"{a}0") for a, b in zip("zyx", SMALL_BLOCK)]
    return vox.groupBy("volume_id", *corner).agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total"))


@query("src_12_pending", f"{FILES} SELECT path FROM files WHERE file_id%4<>0")
def _(t):
    return FI.pending(t.files, t.files.where("file_id % 4 = 0"), ["path"]).select("path")


@query("src_13_append_scores", f"""{VOX} SELECT 'a' AS run_id, volume_id, count(*) FILTER (gt>0) gt_fg, NULL::DOUBLE hd95 FROM vox GROUP BY 2
  UNION ALL SELECT 'b', volume_id, count(*) FILTER (gt>0), max(raw)::DOUBLE FROM vox GROUP BY 2""")
def _(t):
    path = staging(t, "scores")
    n = F.count(F.when(F.col("gt") > 0, 1)).alias("gt_fg")
    FI.append_scores(t.vox.groupBy("volume_id").agg(n).withColumn("run_id", F.lit("a")), path)
    FI.append_scores(t.vox.groupBy("volume_id").agg(n, F.max("raw").cast("double").alias("hd95")).withColumn("run_id", F.lit("b")), path)
    return FI.read_scores(t.spark, path).select("run_id", "volume_id", "gt_fg", "hd95")


def pyramid(t):
    """Three levels per volume; only every third volume knows its voxel size."""
    lv = t.volumes.withColumn("l", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    shape = F.array(*[F.ceil(F.col(n) / F.pow(F.lit(2), F.col("l"))).cast("long") for n in ("nz", "ny", "nx")])
    known = F.when((F.col("l") == 0) & (F.col("volume_id") % 3 == 0), F.array(F.lit(0.03), F.lit(0.005), F.lit(0.007)))
    return lv.select(F.col("volume_id").alias("store"), F.lit("p").alias("parent"), F.concat(F.lit("s"), "l").alias("level"),
                     shape.alias("shape"), known.alias("voxel_size"))


_SIZED = f"""{VOX}, b AS (SELECT volume_id store, nz, ny, nx, volume_id%3=0 own FROM vol), k AS (SELECT nz, ny, nx, bool_or(own) has FROM b GROUP BY 1,2,3),
 s AS (SELECT store, nz, ny, nx, CASE WHEN has THEN 0.03::DOUBLE ELSE 1.0::DOUBLE END vz, CASE WHEN has THEN 0.005::DOUBLE ELSE 1.0::DOUBLE END vy, CASE WHEN has THEN 0.007::DOUBLE ELSE 1.0::DOUBLE END vx FROM b JOIN k USING (nz,ny,nx))"""


@query("src_14_multiscale_repair", f"""{_SIZED} SELECT store, 's'||l AS "level", round(vz*nz/ceil(nz/pow(2,l)),9) z, round(vy*ny/ceil(ny/pow(2,l)),9) y, round(vx*nx/ceil(nx/pow(2,l)),9) x FROM s, range(3) r(l)""")
def _(t):
    out = FI.repair_multiscale(pyramid(t), [1.0, 1.0, 1.0])
    return out.select("store", "level", *[F.round(F.col("voxel_size")[i], 9).alias(a) for i, a in enumerate("zyx")])


@query("src_14_multiscale_document")
def _(t):
    return FI.multiscale_document(FI.repair_multiscale(pyramid(t), [1.0, 1.0, 1.0]))


@query("src_15_guarded_copy", f"{VOX} SELECT volume_id, nz, ny, nx FROM vol WHERE nz%4=0")
def _(t):
    target = t.volumes.withColumn("nz", (F.floor((F.col("nz") + 3) / 4) * 4).cast("long"))
    return FI.guarded_copy(t.volumes, target, ["volume_id"]).select("volume_id", "nz", "ny", "nx")


@query("src_15_copied_arrays", f"{VOX} SELECT volume_id, z, y, x, gt AS label FROM vox JOIN vol USING (volume_id) WHERE gt>0 AND nz%4=0")
def _(t):
    """Chunks are copied for equal shapes only; what the new arrays hold is read back."""
    target = t.volumes.withColumn("nz", (F.floor((F.col("nz") + 3) / 4) * 4).cast("long"))
    parts = CH.encode(t.labels("gt"), "label", t.volumes, "<i8", SMALL_BLOCK)
    root = staging(t, "copied")
    drain(ST.copy_guarded(parts, t.volumes, target, root, "labels/mito", SMALL_BLOCK, "first"))
    return CH.decode(ST.read_zarr(ST.zarr_plan(ST.zarr_catalog(t.spark, root)))).withColumn("volume_id", volume_number())


@query("stm_1_pick_up", f"{VOX} SELECT volume_id, gt AS label, count(*) volume_vx FROM vox WHERE gt>0 GROUP BY 1,2")
def _(t):
    """New voxel files are measured once; the per-batch partial counts add up."""
    from voxelloom.operators.objects import voxel_count

    folder, out, check = staging(t, "arrivals"), staging(t, "measured"), staging(t, "progress")
    schema = t.labels("gt").schema
    handle = J.batch_to_table(voxel_count, out)
    arrivals = t.labels("gt")
    for part in ("z < 2", "z >= 2"):
        arrivals.where(part).write.mode("append").parquet(folder)
        J.pick_up(t.spark, folder, schema, check, handle).awaitTermination()
    return t.spark.read.parquet(out).groupBy("volume_id", "label").agg(F.sum("volume_vx").alias("volume_vx"))


@query("stm_2_score_ledger", "SELECT event_type run_id, count(*) files, round(avg(value),6) mean_value FROM events GROUP BY 1")
def _(t):
    """Every score arrives twice; the ledger counts it once."""
    folder, out, check = staging(t, "scores"), staging(t, "ledger"), staging(t, "progress")
    scores = t.table("events").selectExpr("event_type run_id", "event_id file", "value")
    for _ in range(2):
        scores.write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    ledger = J.running_means(stream, "run_id", "file", ["value"])

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/latest")

    (ledger.writeStream.outputMode("complete").option("checkpointLocation", check)
     .trigger(availableNow=True).foreachBatch(keep).start().awaitTermination())
    return rounded(t.spark.read.parquet(f"{out}/latest"), "mean_value")


@query("stm_2_ledger_updates", "SELECT event_type run_id, count(*) files, round(avg(value),6) mean_value FROM events GROUP BY 1")
def _(t):
    """The ledger in update mode with bounded state; all scores arrive again after a restart."""
    folder, out, check = staging(t, "scores"), staging(t, "ledger"), staging(t, "progress")
    scores = t.table("events").selectExpr("event_type run_id", "event_id file", "cast(ts as timestamp) scored", "value")
    for _ in range(2):
        scores.write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(scores.schema).parquet(folder)
        J.keep_ledger(stream, out, check, "run_id", "file", ["value"], "scored", "60 days").awaitTermination()
    return rounded(J.read_ledger(t.spark, out, "run_id"), "mean_value")
