"""File and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.fixtures import FILES, GROUPS_SQL, VOX
from voxelloom.operators import corpus as K
from voxelloom.plans.measure import SMALL_BLOCK, rounded
from voxelloom.plans.registry import query
from voxelloom.plans.volume import RVOX, cc_sql

STATS = f"""{VOX}, so AS (SELECT volume_id, pred, count(*) n FROM vox WHERE pred>0 AND volume_id<>1 GROUP BY 1,2),
 st AS (SELECT volume_id, count(n) n_instances, coalesce(sum(n),0)::BIGINT total_fg_voxels, any_value(nz*ny*nx) total_voxels, round(coalesce(sum(n),0)/any_value(nz*ny*nx)::DOUBLE,4) fg_fraction,
  round(avg(n),1) vol_mean, round(median(n),1) vol_median, round(stddev_pop(n),1) vol_std, min(n) vol_min, max(n) vol_max FROM vol LEFT JOIN so USING (volume_id) GROUP BY 1)"""


def stats(t):
    # one volume is left without objects, to show its empty row
    return K.instance_stats(t.labels("pred").where("volume_id <> 1"), t.volumes)


@query("agg_6_instance_stats", f"{STATS} SELECT * FROM st")
def _(t):
    return stats(t)


@query("agg_7_summary_row", f"""{STATS} SELECT volume_id::VARCHAR file, * EXCLUDE volume_id FROM st UNION ALL SELECT 'SUMMARY ('||count(*)||' files)', sum(n_instances)::BIGINT, sum(total_fg_voxels)::BIGINT, sum(total_voxels)::BIGINT,
  round(sum(total_fg_voxels)/sum(total_voxels)::DOUBLE,4), round(avg(vol_mean),1), round(median(vol_median),1), round(avg(vol_std),1), min(vol_min), max(vol_max) FROM st HAVING count(*)>1""")
def _(t):
    s = stats(t)
    return s.withColumnRenamed("volume_id", "file").withColumn("file", F.col("file").cast("string")).unionByName(K.summary_row(s))


@query("agg_8_counts_with_total", f"""{VOX}, c AS (SELECT volume_id::VARCHAR file, count(DISTINCT pred) FILTER (pred>0)::DOUBLE objects FROM vox GROUP BY 1)
  SELECT * FROM c UNION ALL SELECT '__TOTAL_ALL_FILES__', sum(objects) FROM c UNION ALL SELECT '__MEAN_PER_FILE__', avg(objects) FROM c""")
def _(t):
    return K.counts_with_total(t.labels("pred"), t.volumes)


_INNER = f"""{RVOX}, om AS (SELECT volume_id, z, y, x, 1 AS label FROM vox WHERE gt>0 AND raw<170), {cc_sql('om', 6, False, tag='o')}, im AS (SELECT volume_id, z, y, x, 1 AS label FROM vox WHERE raw<25), {cc_sql('im', 6, False, tag='i')},
 os AS (SELECT volume_id, root, count(*) n FROM cco GROUP BY 1,2), hi AS (SELECT DISTINCT c.volume_id, c.root FROM cco c JOIN cmi m ON m.volume_id=c.volume_id AND m.k=c.k),
 oz AS (SELECT os.*, hi.root IS NOT NULL has FROM os LEFT JOIN hi USING (volume_id,root)), iz AS (SELECT volume_id, root, count(*) n FROM cci GROUP BY 1,2)"""


def _inner(t):
    return K.inner_counts(t.vox.where("gt > 0 and raw < 170"), t.vox.where("raw < 25"), t.volumes, 6, SMALL_BLOCK)


@query("agg_9_inner_counts", f"""{_INNER}, a AS (SELECT volume_id, count(*) objects, count(*) FILTER (has) objects_with_inner, avg(n) FILTER (has) mo FROM oz GROUP BY 1), b AS (SELECT volume_id, count(*) inner_objects, avg(n) mi FROM iz GROUP BY 1)
  SELECT volume_id, coalesce(objects,0) objects, coalesce(objects_with_inner,0) objects_with_inner, coalesce(inner_objects,0) inner_objects, round(coalesce(mo,0),6) mean_object_size, round(coalesce(mi,0),6) mean_inner_size
  FROM vol LEFT JOIN a USING (volume_id) LEFT JOIN b USING (volume_id)""")
def _(t):
    return rounded(_inner(t)[0], "mean_object_size", "mean_inner_size")


@query("agg_9_corpus_row", f"""{_INNER} SELECT (SELECT count(*) FROM vol) files, (SELECT count(*) FROM oz) objects, (SELECT count(*) FROM oz WHERE has) objects_with_inner, (SELECT count(*) FROM iz) inner_objects,
  (SELECT round(avg(n),6) FROM oz WHERE has) mean_object_size, (SELECT round(stddev_pop(n),6) FROM oz WHERE has) std_object_size, (SELECT round(avg(n),6) FROM iz) mean_inner_size, (SELECT round(stddev_pop(n),6) FROM iz) std_inner_size""")
def _(t):
    return rounded(_inner(t)[1], "mean_object_size", "std_object_size", "mean_inner_size", "std_inner_size")


@query("agg_10_component_sizes", f"""{RVOX}, sm AS (SELECT volume_id, z, y, x, 1 AS label FROM vox WHERE gt IN (3,4,5) AND raw<150 AND volume_id<>1), {cc_sql('sm', 6, False)}, s AS (SELECT volume_id, root, count(*) n FROM cc GROUP BY 1,2)
  SELECT volume_id, count(n) amount_instances, min(n) smallest, max(n) biggest, round(avg(n),6) mean, round(stddev_pop(n),6) std, median(n)::DOUBLE median FROM vol LEFT JOIN s USING (volume_id) GROUP BY 1""")
def _(t):
    lab = t.vox.where("gt > 0 and raw < 150 and volume_id <> 1").select("volume_id", "z", "y", "x", F.col("gt").alias("label"))
    return rounded(K.component_size_stats(lab, [3, 4, 5], t.volumes, 6, SMALL_BLOCK), "mean", "std")


@query("agg_11_group_presence", f"""{VOX}, i AS (SELECT volume_id, pred label, count(*) n FROM vox WHERE pred>0 GROUP BY 1,2), p AS (SELECT volume_id, group_id, count(*) ids, sum(n) n FROM i JOIN {GROUPS_SQL} USING (label) GROUP BY 1,2),
  s AS (SELECT group_id, count(*) n_files, avg(ids) a, avg(n/(nz*ny*nx)::DOUBLE) b FROM p JOIN vol USING (volume_id) GROUP BY 1)
  SELECT g.group_id::BIGINT group_id, coalesce(n_files,0) n_files, round(coalesce(a,0),6) mean_instances, round(coalesce(b,0),6) mean_proportion FROM (SELECT DISTINCT group_id FROM {GROUPS_SQL}) g LEFT JOIN s USING (group_id)""")
def _(t):
    return rounded(K.group_presence(t.labels("pred"), t.label_groups, t.volumes), "mean_instances", "mean_proportion")


@query("agg_12_present_groups", f"""{VOX} SELECT volume_id, group_id::BIGINT group_id, string_agg(label::VARCHAR, ',' ORDER BY label) ids FROM (SELECT DISTINCT volume_id, pred label FROM vox WHERE pred>0) JOIN {GROUPS_SQL} USING (label) GROUP BY 1,2""")
def _(t):
    return K.present_groups(t.labels("pred"), t.label_groups).withColumn("ids", F.array_join("ids", ","))


@query("agg_13_files_with_groups", f"""{VOX}, g AS (SELECT volume_id, group_id, count(DISTINCT z) sl FROM vox JOIN {GROUPS_SQL} ON gt=label WHERE raw<4 GROUP BY 1,2)
  SELECT 'slices' AS rule, volume_id, count(*) "groups" FROM g JOIN vol USING (volume_id) WHERE sl/nz::DOUBLE>0.5 GROUP BY 2 UNION ALL SELECT 'groups', volume_id, count(*) FROM g GROUP BY 2 HAVING count(*)>=3""")
def _(t):
    lab = t.vox.where("gt > 0 and raw < 4").select("volume_id", "z", F.col("gt").alias("label"))
    a = K.files_with_groups(lab, t.label_groups, t.volumes, 1, 0.5).withColumn("rule", F.lit("slices"))
    return a.unionByName(K.files_with_groups(lab, t.label_groups, t.volumes, 3).withColumn("rule", F.lit("groups")))


@query("agg_14_varied_files", f"{VOX}, s AS (SELECT volume_id, count(DISTINCT gt) FILTER (gt>0 AND volume_id<>2) k, count(*) FILTER (gt>0 AND volume_id<>2) n FROM vox GROUP BY 1) SELECT volume_id FROM s JOIN vol USING (volume_id) WHERE k+(n<nz*ny*nx)::INT>1")
def _(t):
    return K.varied_files(t.labels("gt").where("volume_id <> 2"), t.volumes)


@query("agg_15_axis_statistics", f"{VOX} " + " UNION ALL ".join(f"""SELECT '{n}' axis, min({n})::DOUBLE "min", max({n})::DOUBLE "max", round(avg({n}),6) mean, median({n})::DOUBLE median FROM vol""" for n in ("nz", "ny", "nx")))
def _(t):
    return rounded(K.axis_statistics(t.volumes, ["nz", "ny", "nx"]), "mean")


@query("agg_15_shape_prevalence", "SELECT p_brand, p_size::BIGINT p_size, count(*) n FROM part GROUP BY 1,2 ORDER BY n DESC")
def _(t):
    return K.prevalence(t.table("part").select("p_brand", F.col("p_size").cast("long").alias("p_size")), ["p_brand", "p_size"])


@query("agg_16_inconsistent_share", f"""{FILES}, c AS (SELECT file_id, CASE WHEN file_id%11=0 THEN '4x32x16' ELSE '4x32x32' END shape FROM files UNION ALL SELECT file_id, '4x32x32' FROM files)
  SELECT count(*) n_files, sum(b)::BIGINT n_inconsistent, round(100*avg(b),6) AS "percent" FROM (SELECT file_id, (count(DISTINCT shape)>1)::INT b FROM c GROUP BY 1)""")
def _(t):
    shapes = F.array(F.when(F.col("file_id") % 11 == 0, "4x32x16").otherwise("4x32x32"), F.lit("4x32x32"))
    cat = t.files.select("file_id", F.explode(shapes).alias("shape"))
    return rounded(K.inconsistent_share(cat, "file_id", F.col("shape")), "percent")


_META = ["mean", "std"]


@query("agg_17_intensity_metadata", f"""{VOX} SELECT volume_id, max(z)+1 nz, max(y)+1 ny, max(x)+1 nx, max(gt)>0 has_label, min(raw) "min", max(raw) "max", round(avg(raw),6) mean, round(stddev_pop(raw),6) std FROM vox GROUP BY 1""")
def _(t):
    return rounded(K.intensity_metadata(t.vox, "raw", "gt"), *_META)


@query("agg_17_corpus_average", f"""{VOX}, m AS (SELECT volume_id, max(z)+1 nz, max(y)+1 ny, max(x)+1 nx, max(gt)>0 h, min(raw) mi, max(raw) ma, avg(raw) me, stddev_pop(raw) sd FROM vox GROUP BY 1)
  SELECT count(*) n_files, round(avg(nz),6) avg_nz, round(avg(ny),6) avg_ny, round(avg(nx),6) avg_nx, round(avg(mi),6) avg_min, round(avg(ma),6) avg_max, round(avg(me),6) avg_mean, round(avg(sd),6) avg_std, count(*) FILTER (h) n_labelled FROM m""")
def _(t):
    out = K.corpus_average(K.intensity_metadata(t.vox, "raw", "gt"))
    return rounded(out, *[c for c in out.columns if c.startswith("avg_")])


@query("agg_18_labels_per_split", f"""{VOX}, s AS (SELECT volume_id, count(DISTINCT gt) FILTER (gt>0) k FROM vox GROUP BY 1) SELECT CASE WHEN volume_id%3=0 THEN 'val' ELSE 'train' END split, count(*) n_files, sum(k)::BIGINT n_instances FROM s GROUP BY 1""")
def _(t):
    per = t.vox.groupBy("volume_id").agg(F.count_distinct(F.when(F.col("gt") > 0, F.col("gt"))).alias("k"))
    side = F.when(F.col("volume_id") % 3 == 0, "val").otherwise("train").alias("split")
    return per.groupBy(side).agg(F.count(F.lit(1)).alias("n_files"), F.sum("k").alias("n_instances"))


@query("agg_19_state_composition", f"""{VOX} SELECT volume_id, count(*) FILTER (state=0) n_bg, count(*) FILTER (state=1) n_annotated, count(*) FILTER (state=2) n_unannotated, count(*) FILTER (pred>0) n_inner,
  round(100*count(*) FILTER (pred>0)/count(*) FILTER (state=1)::DOUBLE,6) inner_pct FROM vox GROUP BY ROLLUP(volume_id)""")
def _(t):
    return rounded(K.state_composition(t.vox, "state", F.col("pred") > 0), "inner_pct")


@query("agg_20_duplicate_files", """WITH f AS (SELECT doc_id, lang||'/'||(n_chars%7) AS name, sha256(text) h FROM documents), d AS (SELECT name, h, count(*) copies, min(doc_id) original FROM f GROUP BY 1,2 HAVING count(*)>1)
  SELECT f.name, f.h hash, f.doc_id path, copies, original FROM f JOIN d ON d.name=f.name AND d.h=f.h""")
def _(t):
    f = t.table("documents").select(F.concat_ws("/", "lang", (F.col("n_chars") % 7).cast("string")).alias("name"),
                                    F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("path"))
    return K.duplicate_files(f, "name", "hash", "path")


@query("agg_21_audit", f"""{VOX}, c AS (SELECT volume_id, z, count(DISTINCT l) k, count(*) n FROM (SELECT volume_id, z, gt l FROM vox WHERE gt>0 AND (z<>1 OR volume_id%2=0)) GROUP BY 1,2), sl AS (SELECT volume_id, unnest(range(0,nz)) z, ny*nx a FROM vol)
  SELECT volume_id, 'missing dataset' AS issue FROM vol WHERE volume_id%4=3 UNION ALL SELECT DISTINCT volume_id, 'constant slice' FROM sl LEFT JOIN c USING (volume_id,z) WHERE k IS NULL OR (k=1 AND n=a)""")
def _(t):
    lab = t.labels("gt").where("z <> 1 or volume_id % 2 = 0")
    catalog = t.volumes.select("volume_id", F.explode(F.when(F.col("volume_id") % 4 == 3, F.array(F.lit("raw"))).otherwise(
        F.array(F.lit("raw"), F.lit("labels/mitochondria")))).alias("key"))
    return K.audit(t.volumes, catalog, "labels/mitochondria", K.constant_slices(lab, t.volumes))
