"""Projection, label mapping and pairing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.fixtures import FILES, GRID, GROUPS_SQL, VOX
from voxelloom.functions import naming as N
from voxelloom.functions import shape as S
from voxelloom.operators import labels as L
from voxelloom.operators import pairing as P
from voxelloom.plans.measure import MOM, EULER, OBJ, SMALL_BLOCK, rounded
from voxelloom.operators import objects as O
from voxelloom.operators.ordered import exact_quantiles
from voxelloom.fixtures import VOXEL_UM
from voxelloom.plans.registry import query

VK = ["volume_id", "z", "y", "x"]


@query("prj_1_threshold", f"{VOX} SELECT volume_id, z, y, x, fg>0.5 AS mask, raw<64 AS dark FROM vox")
def _(t):
    return L.binarise(L.binarise(t.vox.select(*VK, "fg", "raw"), F.col("fg") > 0.5), F.col("raw") < 64, "dark").drop("fg", "raw")


@query("prj_2_keep_ids", f"""{VOX}, kept AS (SELECT volume_id, z, y, x FROM vox WHERE pred IN (15))
  SELECT * FROM kept UNION ALL SELECT volume_id, z, y, x FROM vox WHERE gt<>0 AND volume_id NOT IN (SELECT volume_id FROM kept)""")
def _(t):
    return L.keep_ids(t.labels("pred"), [15], t.labels("gt"))


@query("prj_3_group_remap", f"""{VOX}, g AS (SELECT label, max(group_id) group_id FROM {GROUPS_SQL} GROUP BY 1)
  SELECT volume_id, z, y, x, coalesce(group_id,0)::BIGINT group_id FROM vox LEFT JOIN g ON gt=label WHERE gt>0""")
def _(t):
    return L.group_remap(t.labels("gt"), t.label_groups).select(*VK, "group_id")


@query("prj_4_group_channels", f"""{VOX} SELECT volume_id, z, y, x, group_id::BIGINT group_id FROM vox JOIN {GROUPS_SQL} ON gt=label""")
def _(t):
    return L.group_channels(t.labels("gt"), t.label_groups).select(*VK, "group_id")


@query("prj_5_apply_mapping", f"""{VOX}, p AS (SELECT volume_id, pred, gt, count(*) n FROM vox WHERE pred>0 GROUP BY 1,2,3),
  s AS (SELECT volume_id, pred, sum(n) size FROM p GROUP BY 1,2),
  r AS (SELECT *, row_number() OVER (PARTITION BY volume_id,pred ORDER BY n DESC, gt) k FROM p WHERE gt<>0),
  m AS (SELECT volume_id, pred, gt class_id FROM r JOIN s USING (volume_id,pred) WHERE k=1 AND n>=0.7*size)
  SELECT volume_id, z, y, x, coalesce(class_id,0) class_id FROM vox LEFT JOIN m USING (volume_id,pred) WHERE pred>0""")
def _(t):
    v = t.vox.where("pred > 0")
    mapping = O.majority_class(v, "pred", "gt", 0.7).select("volume_id", "pred", "class_id")
    return L.apply_mapping(v, mapping, "pred", "class_id").select(*VK, "class_id")


@query("prj_6_sequential", f"""{VOX} SELECT volume_id, label, dense_rank() OVER (PARTITION BY volume_id ORDER BY label) new_label, n FROM
  (SELECT volume_id, pred label, count(*) n FROM vox WHERE pred>0 GROUP BY 1,2)""")
def _(t):
    return L.sequential(t.labels("pred")).groupBy("volume_id", "label", "new_label").agg(F.count(F.lit(1)).alias("n"))


@query("prj_7_is_binary", f"""{VOX} SELECT volume_id, 'gt' AS kind, max(gt)<=1 is_binary FROM vox GROUP BY 1
  UNION ALL SELECT volume_id, 'mask', max(least(gt,1))<=1 FROM vox GROUP BY 1""")
def _(t):
    a = L.is_binary(t.vox.select("volume_id", F.col("gt").alias("label"))).withColumn("kind", F.lit("gt"))
    b = L.is_binary(t.vox.select("volume_id", F.least("gt", F.lit(1)).alias("label"))).withColumn("kind", F.lit("mask"))
    return a.unionByName(b)


@query("prj_8_mask_conversion", f"""{VOX} SELECT volume_id, z, y, x, CASE WHEN gt>0 THEN 1 ELSE 0 END::BIGINT any_label,
  CASE WHEN state=2 THEN 1 ELSE 0 END::BIGINT second_class FROM vox""")
def _(t):
    return t.vox.select(*VK, (F.col("gt") > 0).cast("long").alias("any_label"), (F.col("state") == 2).cast("long").alias("second_class"))


@query("prj_9_merge_masks", f"{VOX} SELECT volume_id, z, y, x FROM vox WHERE gt>0 UNION SELECT volume_id, z, y, x FROM vox WHERE pred>0")
def _(t):
    return L.union_masks(t.labels("gt"), t.labels("pred"))


@query("prj_10_crop", f"{VOX} SELECT volume_id, z-1 z, y-4 y, x-8 x, raw FROM vox WHERE z>=1 AND z<3 AND y>=4 AND y<20 AND x>=8 AND x<30")
def _(t):
    return L.crop(t.vox.select(*VK, "raw"), {"z": (1, 3), "y": (4, 20), "x": (8, 30)})


@query("prj_11_crop_to_shape", f"""{VOX}, s AS (SELECT volume_id, greatest(0,nz-2)//2 sz, greatest(0,ny-20)//2 sy, greatest(0,nx-20)//2 sx FROM vol)
  SELECT 'centre' AS kind, volume_id, z-sz z, y-sy y, x-sx x, raw FROM vox JOIN s USING (volume_id)
   WHERE z>=sz AND z<sz+2 AND y>=sy AND y<sy+20 AND x>=sx AND x<sx+20
  UNION ALL SELECT 'corner', volume_id, z, y, x, raw FROM vox WHERE z<2 AND y<20 AND x<20""")
def _(t):
    v = t.vox.select(*VK, "raw")
    a = L.crop_to_shape(v, t.volumes, (2, 20, 20), True).withColumn("kind", F.lit("centre"))
    return a.unionByName(L.crop_to_shape(v, t.volumes, (2, 20, 20), False).withColumn("kind", F.lit("corner")))


@query("prj_12_centre_slices", f"""{VOX}, w AS (SELECT volume_id, greatest(0,nz//2-greatest(1,nz//2)//2) a,
   greatest(0,nz//2-greatest(1,nz//2)//2)+greatest(1,nz//2) b, nz FROM vol)
  SELECT volume_id, z, count(*) n FROM vox JOIN w USING (volume_id) WHERE z>=a AND z<least(b,nz) GROUP BY 1,2""")
def _(t):
    return L.centre_slices(t.vox, t.volumes, 0.5).groupBy("volume_id", "z").agg(F.count(F.lit(1)).alias("n"))


@query("prj_13_drop_empty_slices", f"""{VOX}, u AS (SELECT volume_id, z, dense_rank() OVER (PARTITION BY volume_id ORDER BY z)-1 nz2 FROM
   (SELECT DISTINCT volume_id, z FROM vox WHERE raw=7 AND gt>0 AND (volume_id+z)%2=0))
  SELECT volume_id, nz2 z, y, x, raw FROM vox JOIN u USING (volume_id,z)""")
def _(t):
    return L.drop_empty_slices(t.vox.select(*VK, "raw", "gt"), F.expr("raw = 7 and gt > 0 and (volume_id + z) % 2 = 0")).drop("gt")


@query("prj_14_flip_shift", f"{VOX} SELECT volume_id, z, ny-1-y y, x, raw-128 signed, raw back FROM vox JOIN vol USING (volume_id)")
def _(t):
    v = L.flip(t.vox.select(*VK, (F.col("raw") - 128).alias("signed")), t.volumes, "y")
    return v.withColumn("back", L.signed_to_unsigned(F.col("signed")))


@query("prj_15_percentile_normalise", f"""{VOX}, q AS (SELECT volume_id, quantile_cont(raw,0.01) lo, quantile_cont(raw,0.99) hi FROM vox GROUP BY 1)
  SELECT volume_id, z, y, x, round(greatest(0.0,least(1.0,(raw-lo)/(hi-lo+1e-7::DOUBLE))),6) scaled FROM vox JOIN q USING (volume_id)""")
def _(t):
    return rounded(L.normalise_percentile(t.vox.select(*VK, "raw"), "raw", 0.01, 0.99).drop("raw"), "scaled")


@query("prj_16_standardise", f"""{VOX}, q AS (SELECT volume_id, avg(raw) m, stddev_pop(raw) s FROM vox GROUP BY 1)
  SELECT volume_id, z, y, x, round((raw-m)/(s+1e-7::DOUBLE),6)+0.0 scaled FROM vox JOIN q USING (volume_id)""")
def _(t):
    return rounded(L.standardise(t.vox.select(*VK, "raw"), "raw").drop("raw"), "scaled")


SPECIMEN = FILES + """, sp AS (SELECT *, regexp_replace(path,'^.*/','') base FROM files),
spec AS (SELECT file_id, path, CASE WHEN contains(path,'cooper') THEN 'cooper' ELSE 'wichmann' END source,
 CASE WHEN regexp_matches(base,'^(Otof_AVCN\\d+_[0-9A-Za-z]+)_(WT|KO)') THEN 'Otof-'||regexp_extract(base,'^(Otof_AVCN\\d+_[0-9A-Za-z]+)_(WT|KO)',2)
  WHEN regexp_matches(base,'^\\d+_[A-Za-z]\\d+') THEN 'cooper' WHEN regexp_matches(base,'^(WT|KO|M)\\d+') THEN regexp_extract(base,'^(WT|KO|M)\\d+',1) ELSE 'other' END genotype,
 CASE WHEN regexp_matches(base,'^(Otof_AVCN\\d+_[0-9A-Za-z]+)_(WT|KO)') THEN regexp_extract(base,'^(Otof_AVCN\\d+_[0-9A-Za-z]+)_(WT|KO)',1)
  WHEN regexp_matches(base,'^\\d+_[A-Za-z]\\d+') THEN regexp_extract(base,'^\\d+_[A-Za-z]\\d+') WHEN regexp_matches(base,'^(WT|KO|M)\\d+')
  THEN regexp_extract(base,'^(WT|KO|M)\\d+') ELSE split_part(base,'_',1) END specimen FROM sp)"""


@query("prj_17_specimen", f"{SPECIMEN} SELECT path, source, genotype, specimen FROM spec")
def _(t):
    return t.files.select("path", F.inline(F.array(N.specimen(F.col("path")))))


@query("prj_18_run_parameters", f"""{GRID} SELECT dataset, CAST(regexp_extract(dataset,'sd(\\d+)',1) AS BIGINT) sd,
  CAST(regexp_extract(dataset,'ft(\\d+)',1) AS BIGINT) ft, CAST(regexp_extract(dataset,'bt(\\d+)',1) AS BIGINT) bt FROM grid""")
def _(t):
    return t.grid.select("dataset", *[N.run_parameter(F.col("dataset"), p).alias(p) for p in ("sd", "ft", "bt")])


@query("prj_19_strip_halo", f"{FILES} SELECT file_id, regexp_replace(path,'^.*/','') AS name, replace(regexp_replace(path,'^.*/',''),'.h5','') AS stem FROM files")
def _(t):
    tagged = F.concat(F.lit("seg_halo_z8_y64_x64_halo_z4_y32_x32_"), N.basename(F.col("path")))
    return t.files.select("file_id", N.after_halo(tagged).alias("name"), N.stem(F.col("path")).alias("stem"))


@query("prj_20_block_names", f"""{VOX}, b AS (SELECT DISTINCT volume_id, z//2*2 z0, z//2*2+2 z1, y//8*8 y0, y//8*8+8 y1, x//16*16 x0, x//16*16+16 x1 FROM vox)
  SELECT volume_id, z0, z1, y0, y1, x0, x1, format('block_z{{:06d}}_{{:06d}}_y{{:06d}}_{{:06d}}_x{{:06d}}_{{:06d}}.h5',z0,z1,y0,y1,x0,x1) AS name FROM b""")
def _(t):
    size = {"z": 2, "y": 8, "x": 16}
    boxes = t.vox.select("volume_id", *[e for a, s in size.items() for e in (
        (F.floor(F.col(a) / s) * s).alias(f"{a}0"), (F.floor(F.col(a) / s) * s + s).alias(f"{a}1"))]).distinct()
    named = boxes.select("volume_id", N.block_name(*[F.col(c) for c in N.BLOCK_FIELDS]).alias("name"))
    return named.select("volume_id", *N.block_box(F.col("name")), "name")


@query("prj_21_parameter_tag", f"{GRID} SELECT run_no, 'sd'||sd||'_bt0'||bt||'_ft0'||ft AS tag FROM grid")
def _(t):
    return t.grid.select("run_no", N.parameter_tag(
        sd=F.col("sd"), bt=F.concat(F.lit("0."), F.col("bt")), ft=F.concat(F.lit("0."), F.col("ft"))).alias("tag"))


@query("prj_22_substring_filter", f"{FILES} SELECT path FROM files WHERE contains(path,'wichmann') AND NOT contains(path,'KO') AND NOT contains(path,'_eb1')")
def _(t):
    p = F.col("path")
    return t.files.where(N.contains_any(p, ["wichmann"]) & ~N.contains_any(p, ["KO", "_eb1"])).select("path")


@query("prj_23_required_key", f"""{FILES}, keys AS (SELECT file_id, 'raw' AS key FROM files UNION ALL SELECT file_id, 'labels/mitochondria' FROM files WHERE file_id%3=0
    UNION ALL SELECT file_id, 'volumes/mitochondria' FROM files WHERE file_id%5=0)
  SELECT path FROM files SEMI JOIN (SELECT file_id FROM keys WHERE regexp_replace(key,'^.*/','')='mitochondria') USING (file_id)""")
def _(t):
    keys = t.files.select("file_id", F.explode(F.array_compact(F.array(
        F.lit("raw"), F.when(F.col("file_id") % 3 == 0, "labels/mitochondria"),
        F.when(F.col("file_id") % 5 == 0, "volumes/mitochondria")))).alias("key"))
    return t.files.join(keys.where(N.basename(F.col("key")) == "mitochondria"), "file_id", "left_semi").select("path")


@query("prj_24_canonical_label", """WITH p AS (SELECT p_partkey, CASE p_partkey%7 WHEN 0 THEN 'AZ '||p_name WHEN 1 THEN 'Mito '||p_name WHEN 2 THEN 'mito cristae'
   WHEN 3 THEN 'CM '||p_name WHEN 4 THEN 'Endbulb' WHEN 5 THEN 'inner '||p_name ELSE p_name END txt FROM part)
  SELECT p_partkey, txt, CASE WHEN lower(txt) LIKE '%az%' THEN 'labels/az' WHEN lower(txt) LIKE '%mito%' AND lower(txt) NOT LIKE '%cristae%' AND lower(txt) NOT LIKE '%inner%' THEN 'labels/mitochondria'
   WHEN lower(txt) LIKE '%cm%' OR lower(txt) LIKE '%cristae%' OR lower(txt) LIKE '%inner%' THEN 'labels/cristae' WHEN lower(txt) LIKE '%endbulb%' THEN 'labels/endbulb' ELSE 'labels/'||txt END AS key FROM p""")
def _(t):
    txt = F.expr("""case p_partkey%7 when 0 then 'AZ '||p_name when 1 then 'Mito '||p_name when 2 then 'mito cristae'
      when 3 then 'CM '||p_name when 4 then 'Endbulb' when 5 then 'inner '||p_name else p_name end""")
    return t.table("part").select("p_partkey", txt.alias("txt")).withColumn("key", N.canonical_label(F.col("txt")))


@query("prj_25_log_columns", "SELECT l_orderkey, l_linenumber, round(log10(l_extendedprice+1e-9),6) log10_l_extendedprice, round(log10(l_discount+1e-9),6) log10_l_discount FROM lineitem")
def _(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", *[
        F.round(S.log10_shifted(F.col(c)), 6).alias(f"log10_{c}") for c in ("l_extendedprice", "l_discount")])


_SHAPES = f"""{MOM}, {EULER}, sh AS (SELECT volume_id, label, elongation_a_over_c el, flatness_b_over_c fl, euler_char ec, volume_vx*6.25e-7 vol,
  CASE WHEN volume_vx%3=0 THEN 0.9 ELSE 0.4 END sp, CASE WHEN volume_vx%5=0 THEN 1 ELSE 0 END br
  FROM axes JOIN euler USING (volume_id,label) JOIN box USING (volume_id,label))"""


def _shapes(t):
    lab = t.labels("gt")
    ax = O.principal_axes(lab, VOXEL_UM)
    ec = O.lattice_measures(lab, t.volumes, VOXEL_UM, SMALL_BLOCK).select(*O.OBJECT, "euler_char")
    vx = F.col("volume_vx")
    return ax.join(ec, O.OBJECT).join(O.voxel_count(lab), O.OBJECT).select(
        *O.OBJECT, "elongation_a_over_c", "flatness_b_over_c", "euler_char", (vx * 6.25e-7).alias("volume_um3"),
        F.when(vx % 3 == 0, 0.9).otherwise(0.4).alias("sphericity"), F.when(vx % 5 == 0, 1).otherwise(0).alias("skeleton_branches"))


@query("prj_26_phenotype_shape", f"""{_SHAPES} SELECT volume_id, label, CASE WHEN el<1.6 AND fl<1.2 AND ec=1 THEN 'Round' WHEN el>=3.5 AND fl<1.3 AND ec=1 THEN 'Tubular'
  WHEN ec=0 THEN 'Donut' WHEN br>0 THEN 'Branched' ELSE 'Other' END phenotype FROM sh""")
def _(t):
    c = {n: F.col(n) for n in ("elongation_a_over_c", "flatness_b_over_c", "euler_char", "skeleton_branches")}
    return _shapes(t).select(*O.OBJECT, S.phenotype_by_shape(*c.values()).alias("phenotype"))


@query("prj_27_phenotype_volume", f"""{_SHAPES}, q AS (SELECT quantile_cont(vol,0.95) v95 FROM sh)
  SELECT volume_id, label, CASE WHEN ec=0 THEN 'Donut' WHEN br>0 THEN 'Branched' WHEN vol>=v95 AND sp<=0.5 THEN 'Swollen' WHEN el<=1.6 AND sp>=0.8 THEN 'Round'
  WHEN el>=3.0 AND fl<=1.2 THEN 'Tubular' ELSE 'Other' END phenotype FROM sh, q""")
def _(t):
    objs = _shapes(t)
    high = exact_quantiles(objs, [], "volume_um3", [0.95], ["_v95"]).withColumn("_k", F.lit(1))
    cols = [F.col(n) for n in ("elongation_a_over_c", "flatness_b_over_c", "sphericity", "euler_char", "skeleton_branches", "volume_um3", "_v95")]
    return objs.withColumn("_k", F.lit(1)).join(F.broadcast(high), "_k").select(
        *O.OBJECT, S.phenotype_by_volume(*cols).alias("phenotype"))


@query("prj_28_state_masks", f"{VOX} SELECT volume_id, state, abs(state-2)>=0.5 loss_mask, state<>1 ignored, count(*) n FROM vox GROUP BY 1,2,3,4")
def _(t):
    loss, ignored = L.state_masks(F.col("state"))
    return t.vox.select("volume_id", "state", loss.alias("loss_mask"), ignored.alias("ignored")).groupBy(
        "volume_id", "state", "loss_mask", "ignored").agg(F.count(F.lit(1)).alias("n"))


@query("prj_29_voxel_size", """SELECT p_partkey, round(p_size*1e-3,9) z, round(CASE p_partkey%3 WHEN 0 THEN p_size ELSE p_size+1 END*1e-3,9) y,
  round(CASE p_partkey%3 WHEN 0 THEN p_size WHEN 1 THEN p_size+1 ELSE p_size+2 END*1e-3,9) x FROM part""")
def _(t):
    nm = F.expr("""case p_partkey%3 when 0 then array(double(p_size)) when 1 then array(double(p_size),double(p_size+1))
      else array(double(p_size),double(p_size+1),double(p_size+2)) end""")
    um = t.table("part").select("p_partkey", S.voxel_size_um(nm).alias("s"))
    return um.select("p_partkey", *[F.round(f"s.{a}", 9).alias(a) for a in "zyx"])


@query("prj_30_metadata_predicates", """SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' AND p_size>=10 AND (p_brand='Brand#2' OR p_type='ECONOMY')""")
def _(t):
    p = t.table("part").withColumn("shapes", F.array(
        F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("type")), F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("type"))))
    return p.where(F.col("p_name").ilike("%RING%") & (F.col("p_size") >= 10)
                   & F.exists("shapes", lambda s: s["type"].isin("Brand#2", "ECONOMY"))).select("p_partkey", "p_name")


# ------------------------------------------------------------------ joins
@query("jn_1_label_file", f"""{FILES}, r AS (SELECT file_id, path, split_part(regexp_replace(path,'^.*/',''),'_',1)||'_'||split_part(regexp_replace(path,'^.*/',''),'_',2) stem FROM files),
  l AS (SELECT '/lab/'||replace(regexp_replace(path,'^.*/',''),'.h5','_seg.tif') label_path, replace(regexp_replace(path,'^.*/',''),'.h5','_seg') lstem FROM files WHERE file_id%3<>0),
  m AS (SELECT file_id, min(label_path) label_path FROM r JOIN l ON contains(lstem, stem) GROUP BY 1)
  SELECT file_id, path, label_path FROM r LEFT JOIN m USING (file_id)""")
def _(t):
    base = N.basename(F.col("path"))
    raw = t.files.select("file_id", "path", F.substring_index(base, "_", 2).alias("stem"))
    lab = t.files.where("file_id % 3 <> 0").select(F.concat(F.lit("/lab/"), N.stem(F.col("path")), F.lit("_seg.tif")).alias("label_path"))
    lab = lab.withColumn("lstem", N.stem(F.col("label_path"))).withColumn("pos", F.col("label_path"))
    return P.contains_match(raw, lab, "stem", "lstem", "pos", "label_path").drop("stem")


@query("jn_2_model_recording", f"""{FILES}, m AS (SELECT file_id, replace(regexp_replace(path,'^.*/',''),'_combined.h5','_model.mod') mod_name FROM files),
  r AS (SELECT replace(regexp_replace(path,'^.*/',''),'_combined.h5','_rec.mrc') rec_name FROM files WHERE file_id%2=0),
  mb AS (SELECT *, replace(replace(replace(replace(mod_name,'_model2',''),'_model',''),'.mod',''),'model','') b FROM m),
  rb AS (SELECT *, replace(replace(replace(replace(rec_name,'_SP.rec',''),'_rec',''),'.rec',''),'.mrc','') rb FROM r),
  hit AS (SELECT file_id, min(rec_name) rec_name FROM mb JOIN rb ON contains(rb, b) GROUP BY 1)
  SELECT file_id, mod_name, rec_name FROM mb LEFT JOIN hit USING (file_id)""")
def _(t):
    base = N.basename(F.col("path"))
    mods = t.files.select("file_id", F.replace(base, F.lit("_combined.h5"), F.lit("_model.mod")).alias("mod_name"))
    mods = mods.withColumn("b", N.strip_marks(F.col("mod_name"), N.MODEL_MARKS))
    recs = t.files.where("file_id % 2 = 0").select(F.replace(base, F.lit("_combined.h5"), F.lit("_rec.mrc")).alias("rec_name"))
    recs = recs.withColumn("rb", N.strip_marks(F.col("rec_name"), N.RECORDING_MARKS)).withColumn("pos", F.col("rec_name"))
    return P.contains_match(mods, recs, "b", "rb", "pos", "rec_name").drop("b")


@query("jn_3_pair_by_position", f"""{FILES}, a AS (SELECT path, row_number() OVER (ORDER BY path) rn FROM files),
  b AS (SELECT '/mask/'||file_id::VARCHAR mask, row_number() OVER (ORDER BY '/mask/'||file_id::VARCHAR) rn FROM files) SELECT rn, path, mask FROM a JOIN b USING (rn)""")
def _(t):
    masks = t.files.select(F.concat(F.lit("/mask/"), F.col("file_id")).alias("mask"))
    return P.pair_by_position(t.files, masks, "path", "mask")


@query("jn_4_role_table", f"""{FILES}, f AS (SELECT file_id, 'raw' AS r, 'b'||file_id//3 AS base FROM files WHERE file_id%3=0 UNION ALL
    SELECT file_id, 'mitochondria', 'b'||file_id//3 FROM files WHERE file_id%3=1 AND file_id%4<>0 UNION ALL SELECT file_id, 'cristae', 'b'||file_id//3 FROM files WHERE file_id%3=2 AND file_id%5<>0),
  w AS (SELECT base, min(CASE r WHEN 'raw' THEN base||'_raw.tif' END) raw, min(CASE r WHEN 'mitochondria' THEN base||'_mitochondria.tif' END) mitochondria,
    min(CASE r WHEN 'cristae' THEN base||'_cristae.tif' END) cristae FROM f GROUP BY 1)
  SELECT *, concat_ws(', ', CASE WHEN raw IS NULL THEN 'raw' END, CASE WHEN mitochondria IS NULL THEN 'mitochondria' END, CASE WHEN cristae IS NULL THEN 'cristae' END) missing FROM w""")
def _(t):
    roles = ["raw", "mitochondria", "cristae"]
    names = t.files.where("not (file_id%3=1 and file_id%4=0) and not (file_id%3=2 and file_id%5=0)").selectExpr(
        "concat('b', file_id div 3, '_', element_at(array('raw','mitochondria','cristae'), int(file_id%3)+1), '.tif') path")
    return P.role_table(names.select("path", F.regexp_extract("path", "^(.*)_([a-z]+)\\.tif$", 1).alias("base"),
                                     F.regexp_extract("path", "^(.*)_([a-z]+)\\.tif$", 2).alias("role")), roles)


@query("jn_5_coarse_lookup", f"""{VOX}, c AS (SELECT volume_id, z, y//2 y, x//2 x, cell FROM vox WHERE y%2=0 AND x%2=0 AND y<30),
  cs AS (SELECT volume_id, max(z) mz, max(y) my, max(x) mx FROM c GROUP BY 1)
  SELECT v.volume_id, v.z, v.y, v.x, coalesce(c.cell,0) cell FROM vox v JOIN cs USING (volume_id) LEFT JOIN c ON c.volume_id=v.volume_id AND c.z=least(v.z,mz)
   AND c.y=least(v.y//2,my) AND c.x=least(v.x//2,mx) WHERE v.gt>0""")
def _(t):
    coarse = t.vox.where("y%2=0 and x%2=0 and y<30").selectExpr("volume_id", "z", "y div 2 y", "x div 2 x", "cell")
    shape = coarse.groupBy("volume_id").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "zyx"])
    return L.coarse_lookup(t.vox.where("gt > 0").select(*VK), coarse, shape, (1, 2, 2), "cell")


@query("jn_6_contingency", f"{VOX} SELECT volume_id, gt, pred, count(*) n FROM vox WHERE gt>0 OR pred>0 GROUP BY 1,2,3")
def _(t):
    return O.contingency(t.vox.where("gt > 0 or pred > 0"), "gt", "pred")


@query("jn_7_iou", f"""{VOX}, p AS (SELECT volume_id, gt, pred, count(*) n FROM vox GROUP BY 1,2,3), a AS (SELECT volume_id, gt, sum(n) na FROM p WHERE gt>0 GROUP BY 1,2),
  b AS (SELECT volume_id, pred, sum(n) nb FROM p WHERE pred>0 GROUP BY 1,2)
  SELECT volume_id, gt, pred, n, round(n/(na+nb-n),6)::DOUBLE iou FROM p JOIN a USING (volume_id,gt) JOIN b USING (volume_id,pred) WHERE gt>0 AND pred>0""")
def _(t):
    return rounded(L.overlaps(t.vox, "gt", "pred").select("volume_id", "gt", "pred", "n", "iou"), "iou")


@query("jn_11_anti_pinned", f"""{SPECIMEN}, pin AS (SELECT * FROM spec WHERE file_id%97=0)
  SELECT path FROM spec s WHERE path NOT IN (SELECT path FROM pin) AND NOT EXISTS (SELECT 1 FROM pin p WHERE p.source=s.source AND p.specimen=s.specimen)""")
def _(t):
    spec = t.files.select("file_id", "path", F.inline(F.array(N.specimen(F.col("path")))))
    pinned = spec.where("file_id % 97 = 0")
    return spec.join(pinned, "path", "left_anti").join(pinned, ["source", "specimen"], "left_anti").select("path")


@query("jn_14_neighbour_pairs", f"""{OBJ}, o AS (SELECT volume_id, label, z+dz z, y+dy y, x+dx x FROM lab, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx))
  SELECT o.volume_id, o.label, l.label neighbour, count(*) n FROM o JOIN lab l USING (volume_id,z,y,x) GROUP BY 1,2,3""")
def _(t):
    return L.neighbour_pairs(t.labels("gt"), 6).groupBy("volume_id", "label", "neighbour").agg(F.count(F.lit(1)).alias("n"))


@query("jn_15_score_metadata", f"""{SPECIMEN} SELECT replace(regexp_replace(path,'^.*/',''),'.h5','') AS stem, genotype, round(c_acctbal,2) score FROM spec JOIN customer ON c_custkey=file_id""")
def _(t):
    meta = t.files.select(N.stem(F.col("path")).alias("stem"), F.inline(F.array(N.specimen(F.col("path"))))).select("stem", "genotype")
    scores = t.files.join(t.table("customer"), F.col("file_id") == F.col("c_custkey")).select(
        N.stem(F.col("path")).alias("stem"), F.round("c_acctbal", 2).alias("score"))
    return scores.join(meta, "stem").select("stem", "genotype", "score")
