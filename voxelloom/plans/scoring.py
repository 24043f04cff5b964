"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.fixtures import FILES, GROUPS_SQL, VOX, VOXEL_UM
from voxelloom.functions import naming as N
from voxelloom.operators import evaluate as E
from voxelloom.operators import labels as L
from voxelloom.operators import objects as O
from voxelloom.plans.measure import SMALL_BLOCK, rounded
from voxelloom.plans.registry import query

def G():
    return F.col("gt") > 0


PRF = ["precision", "recall", "dice"]
_PRF_SQL = """round(tp/(tp+fp+1e-8::DOUBLE),6) "precision", round(tp/(tp+fn+1e-8::DOUBLE),6) recall, round(2*tp/(2*tp+fp+fn+1e-8::DOUBLE),6) dice"""
_CONF = """c AS (SELECT volume_id, count(*) FILTER (gt>0 AND pred>0) tp, count(*) FILTER (gt=0 AND pred>0) fp, count(*) FILTER (gt>0 AND pred=0) fn,
  count(*) FILTER (pred>0) pred_fg, count(*) FILTER (gt>0) gt_fg, count(*) eval_voxels FROM vox WHERE state=1 GROUP BY 1)"""


def binary(t):
    return E.binary_scores(t.vox, G(), F.col("pred") > 0, ["volume_id"], ignore=L.state_masks(F.col("state"))[1])


@query("evl_1_binary_scores", f"{VOX}, {_CONF} SELECT *, {_PRF_SQL} FROM c")
def _(t):
    return rounded(binary(t), *PRF)


def inst_sql(src, gt, pred, keys, prefix=""):
    k = ", ".join(keys)
    return f"""{prefix}ip AS (SELECT {k}, {gt} g, {pred} p, count(*) n FROM {src} GROUP BY ALL),
 ia AS (SELECT {k}, g, CAST(sum(n) AS BIGINT) na FROM ip WHERE g>0 GROUP BY ALL), ib AS (SELECT {k}, p, CAST(sum(n) AS BIGINT) nb FROM ip WHERE p>0 GROUP BY ALL),
 io AS (SELECT {k}, g, p, n, na, nb, n::DOUBLE/(na+nb-n) iou, 2.0::DOUBLE*n/(na+nb) d FROM ip JOIN ia USING ({k},g) JOIN ib USING ({k},p) WHERE g>0 AND p>0),
 itp AS (SELECT {k}, count(*) tp FROM io WHERE iou>=0.5 GROUP BY ALL),
 ibg AS (SELECT {k}, sum(d) s FROM (SELECT {k}, g, max(d) d FROM io GROUP BY ALL) GROUP BY ALL), ibp AS (SELECT {k}, sum(d) s FROM (SELECT {k}, p, max(d) d FROM io GROUP BY ALL) GROUP BY ALL),
 icn AS (SELECT {k}, count(DISTINCT g) FILTER (g>0) n_gt, count(DISTINCT p) FILTER (p>0) n_pred FROM ip GROUP BY ALL),
 inst AS (SELECT {k}, coalesce(tp,0) tp, n_gt, n_pred, CASE WHEN n_pred>0 THEN coalesce(tp,0)/n_pred ELSE 0.0 END "precision", CASE WHEN n_gt>0 THEN coalesce(tp,0)/n_gt ELSE 0.0 END recall,
  CASE WHEN n_gt+n_pred>0 THEN 2*coalesce(tp,0)/(n_gt+n_pred) ELSE 0.0 END f1_score,
  least(CASE WHEN n_gt>0 THEN coalesce(ibg.s,0)/n_gt ELSE 0.0 END, CASE WHEN n_pred>0 THEN coalesce(ibp.s,0)/n_pred ELSE 0.0 END) sbd_score,
  n_pred||' / '||n_gt pred_actual FROM icn LEFT JOIN itp USING ({k}) LEFT JOIN ibg USING ({k}) LEFT JOIN ibp USING ({k}))"""


INST = VOX + ", " + inst_sql("vox", "gt", "pred", ["volume_id"])
_I6 = ["precision", "recall", "f1_score", "sbd_score"]
_I6_SQL = ", ".join(f'round("{c}",6)::DOUBLE "{c}"' for c in _I6)


def instances(t):
    return E.instance_scores(t.vox, "gt", "pred", ["volume_id"])


@query("evl_2_instance_matching", f'{INST} SELECT volume_id, tp, n_gt, n_pred, round("precision",6)::DOUBLE "precision", round(recall,6)::DOUBLE recall, round(f1_score,6)::DOUBLE f1_score FROM inst')
def _(t):
    return rounded(instances(t), *_I6).drop("sbd_score", "pred_actual")


@query("evl_2_matching_low_threshold")
def _(t):
    return rounded(E.instance_scores(t.vox, "gt", "pred", ["volume_id"], 0.1), *_I6).drop("sbd_score", "pred_actual")


@query("evl_3_symmetric_best_dice", f"{INST} SELECT volume_id, round(sbd_score,6)::DOUBLE sbd_score FROM inst")
def _(t):
    return rounded(instances(t), *_I6).select("volume_id", "sbd_score")


@query("evl_4_pred_actual", f"{INST} SELECT volume_id, pred_actual FROM inst")
def _(t):
    return instances(t).select("volume_id", "pred_actual")


_CLS = f"""{VOX}, cg AS (SELECT label, max(group_id) cls FROM {GROUPS_SQL} GROUP BY 1),
 cv AS (SELECT volume_id, z, y, x, gt g, pred p, a.cls gc, b.cls pc FROM vox LEFT JOIN cg a ON gt=a.label LEFT JOIN cg b ON pred=b.label),
 cm AS (SELECT volume_id, z, y, x, class_id::BIGINT class_id, max(g) g, max(p) p FROM (SELECT volume_id,z,y,x,gc class_id,g,0 p FROM cv WHERE gc>0 UNION ALL SELECT volume_id,z,y,x,pc,0,p FROM cv WHERE pc>0) GROUP BY ALL),
 cc AS (SELECT volume_id, class_id, count(*) FILTER (g>0 AND p>0) tp, count(*) FILTER (g=0 AND p>0) fp, count(*) FILTER (g>0 AND p=0) fn FROM cm GROUP BY ALL), """


@query("evl_5_class_scores", _CLS + inst_sql("cm", "g", "p", ["volume_id", "class_id"]) + f""" SELECT volume_id, class_id, {_I6_SQL},
  round(cc.tp/(cc.tp+fp+1e-8::DOUBLE),6) voxel_precision, round(cc.tp/(cc.tp+fn+1e-8::DOUBLE),6) voxel_recall, round(2*cc.tp/(2*cc.tp+fp+fn+1e-8::DOUBLE),6) voxel_dice FROM inst JOIN cc USING (volume_id,class_id)""")
def _(t):
    v = L.group_remap(t.vox, t.label_groups, "gt").withColumnRenamed("group_id", "gc")
    v = L.group_remap(v, t.label_groups, "pred").withColumnRenamed("group_id", "pc")
    return rounded(E.class_scores(v, "gc", "pc", "gt", "pred", ["volume_id"]), *_I6, "voxel_precision", "voxel_recall", "voxel_dice")


@query("evl_6_average_row", f"""{VOX}, {_CONF}, r AS (SELECT volume_id::VARCHAR dataset, tp/(tp+fp+1e-8::DOUBLE) "precision", tp/(tp+fn+1e-8::DOUBLE) recall, 2*tp/(2*tp+fp+fn+1e-8::DOUBLE) dice, tp, fp, fn FROM c)
  SELECT dataset, round("precision",6) "precision", round(recall,6) recall, round(dice,6) dice, tp, fp, fn FROM r
  UNION ALL SELECT 'all-files-averaged', round(avg("precision"),6), round(avg(recall),6), round(avg(dice),6), sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM r""")
def _(t):
    rows = binary(t).withColumn("dataset", F.col("volume_id").cast("string"))
    return rounded(E.with_average(rows, "dataset", PRF, ["tp", "fp", "fn"], "all-files-averaged"), *PRF)


_RANK = """s1 AS (SELECT volume_id, fg, (gt>0)::INT p FROM vox WHERE state=1),
 h AS (SELECT volume_id, fg, sum(p) pos, count(*) a FROM s1 GROUP BY 1,2),
 r AS (SELECT *, sum(pos) OVER w cp, sum(a) OVER w ca, sum(pos) OVER (PARTITION BY volume_id) tp, sum(a) OVER (PARTITION BY volume_id) ta FROM h WINDOW w AS (PARTITION BY volume_id ORDER BY fg DESC)),
 rk AS (SELECT volume_id, max(tp)::BIGINT n_pos, max(ta)::BIGINT n_all, sum(pos/tp*cp/ca) ap, sum((a-pos)*(cp-pos+pos/2)/(tp*(ta-tp))) auc FROM r GROUP BY 1)"""


def ranks(t):
    return E.ranking_scores(t.vox.where(~L.state_masks(F.col("state"))[1]), ["volume_id"], "fg", G())


@query("evl_7_average_precision", f"{VOX}, {_RANK} SELECT volume_id, n_pos, n_all, round(ap,6)::DOUBLE ap FROM rk")
def _(t):
    return rounded(ranks(t).drop("auc"), "ap")


@query("evl_8_roc_auc", f"""{VOX}, s1 AS (SELECT volume_id, fg, gt>0 p FROM vox WHERE state=1),
  r AS (SELECT *, rank() OVER (PARTITION BY volume_id ORDER BY fg) + (count(*) OVER (PARTITION BY volume_id, fg)-1)/2.0::DOUBLE rk FROM s1)
  SELECT volume_id, round((sum(rk) FILTER (p) - count(*) FILTER (p)*(count(*) FILTER (p)+1)/2)/(count(*) FILTER (p)*count(*) FILTER (NOT p)::DOUBLE),6) auc FROM r GROUP BY 1""")
def _(t):
    return rounded(ranks(t).select("volume_id", "auc"), "auc")


@query("evl_9_threshold_sweep", f"""{VOX}, th(threshold) AS (VALUES (0.3::DOUBLE),(0.4::DOUBLE),(0.5::DOUBLE),(0.6::DOUBLE),(0.7::DOUBLE),(0.8::DOUBLE),(0.9::DOUBLE)),
  c AS (SELECT volume_id, threshold, count(*) FILTER (fg>threshold AND gt>0) tp, count(*) FILTER (fg>threshold AND gt=0) fp, count(*) FILTER (NOT fg>threshold AND gt>0) fn
    FROM vox, th WHERE state=1 GROUP BY 1,2) SELECT *, {_PRF_SQL} FROM c""")
def _(t):
    return rounded(E.threshold_sweep(t.vox.where(~L.state_masks(F.col("state"))[1]), ["volume_id"], "fg", G()), *PRF)


@query("evl_10_separation", f"""{VOX} SELECT volume_id, count(*) FILTER (state=1) n_state1, count(*) FILTER (state=1 AND gt>0) gt_fg, count(*) FILTER (state=2) n_state2,
  round(avg(fg) FILTER (state=1 AND gt>0),6) fg_mean_gtpos_state1, round(avg(fg) FILTER (state=1 AND gt=0),6) fg_mean_gtneg_state1,
  round(avg((fg>0.5)::INT) FILTER (state=2),6) frac_fg_gt0p5_state2, round(avg(fg) FILTER (state=2),6) mean_fg_state2 FROM vox GROUP BY 1""")
def _(t):
    return rounded(E.separation(t.vox, ["volume_id"], "fg", "gt", "state"),
                   "fg_mean_gtpos_state1", "fg_mean_gtneg_state1", "frac_fg_gt0p5_state2", "mean_fg_state2")


_SURF = """SELECT m.volume_id, m.z, m.y, m.x FROM (SELECT volume_id, z, y, x FROM vox WHERE {c}>0) m LEFT JOIN
  (SELECT volume_id, z+dz z, y+dy y, x+dx x, count(*) k FROM vox, (VALUES (-1),(0),(1)) a(dz), (VALUES (-1),(0),(1)) b(dy), (VALUES (-1),(0),(1)) c(dx) WHERE {c}>0 GROUP BY ALL) n
  USING (volume_id,z,y,x) WHERE k<27"""
_DIST = "sqrt(pow((a.z-b.z)*0.025::DOUBLE,2)+pow((a.y-b.y)*0.005::DOUBLE,2)+pow((a.x-b.x)*0.005::DOUBLE,2))"


@query("evl_11_hd95", f"""{VOX}, sa AS ({_SURF.format(c='gt')}), sb AS ({_SURF.format(c='pred')}),
  d AS (SELECT a.volume_id, min({_DIST}) d FROM sa a JOIN sb b USING (volume_id) GROUP BY a.volume_id,a.z,a.y,a.x
   UNION ALL SELECT a.volume_id, min({_DIST}) FROM sb a JOIN sa b USING (volume_id) GROUP BY a.volume_id,a.z,a.y,a.x)
  SELECT volume_id, round(quantile_cont(d,0.95),6) hd95 FROM d GROUP BY 1""")
def _(t):
    return rounded(E.hausdorff95(t.labels("gt"), t.labels("pred"), t.volumes, VOXEL_UM, SMALL_BLOCK), "hd95")


_SCORES = """sc AS (SELECT CASE WHEN p_partkey%50=0 THEN 'All-Files averaged '||p_partkey ELSE p_name||p_partkey END dataset, p_brand model, p_size/50.0::DOUBLE dice, p_retailprice/2000 "precision" FROM part)"""


def scores(t):
    return t.table("part").selectExpr(
        "case when p_partkey%50=0 then 'All-Files averaged '||p_partkey else p_name||p_partkey end dataset",
        "p_brand model", "p_size/50.0D dice", "p_retailprice/2000 precision")


@query("evl_12_compare_tables", f"""WITH {_SCORES} SELECT model, count(*) n, round(avg(dice),6) dice, round(avg("precision"),6) "precision" FROM sc
  WHERE NOT (dataset ILIKE '%average%' OR dataset ILIKE '%all-files%') GROUP BY 1""")
def _(t):
    return rounded(E.compare_models(scores(t), "dataset", "model", ["dice", "precision"]), "dice", "precision")


@query("evl_13_model_means", "SELECT l_shipmode_key model, count(*) n, round(avg(l_discount),6) ap, round(avg(l_tax),6) auc FROM (SELECT l_returnflag||l_linestatus l_shipmode_key, * FROM lineitem) GROUP BY 1")
def _(t):
    return t.table("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("ap"), F.round(F.avg("l_tax"), 6).alias("auc"))


_KEYED = f"""{VOX}, kv AS (SELECT volume_id, 'pred' AS key, gt g, pred p FROM vox UNION ALL SELECT volume_id, 'cell', gt, cell FROM vox UNION ALL SELECT volume_id, 'gt', gt, gt FROM vox), """


@query("evl_14_grid_keys", _KEYED + inst_sql("kv", "g", "p", ["volume_id", "key"]) + f" SELECT volume_id, key, tp, n_gt, n_pred, {_I6_SQL}, pred_actual FROM inst")
def _(t):
    long = t.vox.select("volume_id", "gt", "pred", "cell", F.col("gt").alias("same")).select(
        "volume_id", F.col("gt").alias("g"), F.inline(F.array(*[
            F.struct(F.lit(k).alias("key"), F.col(c).alias("p")) for k, c in (("pred", "pred"), ("cell", "cell"), ("gt", "same"))])))
    return rounded(E.instance_scores(long, "g", "p", ["volume_id", "key"]), *_I6)


def _edge(c):
    return f"""SELECT volume_id, {c} label FROM vox JOIN vol USING (volume_id) WHERE {c}>0 GROUP BY volume_id, {c}, ny, nx
      HAVING (min(y)=0)::INT+(max(y)=ny-1)::INT+(min(x)=0)::INT+(max(x)=nx-1)::INT>0"""


@query("evl_15_drop_border_objects", f"""{VOX}, eg AS ({_edge('gt')}), ep AS ({_edge('pred')})
  SELECT 'gt' AS side, volume_id, gt AS label, count(*) n FROM vox WHERE gt>0 AND (volume_id,gt) NOT IN (SELECT (volume_id,label) FROM eg) GROUP BY 2,3
  UNION ALL SELECT 'pred', volume_id, pred, count(*) FROM vox WHERE pred>0 AND (volume_id,pred) NOT IN (SELECT (volume_id,label) FROM ep) GROUP BY 2,3""")
def _(t):
    parts = []
    for side in ("gt", "pred"):
        lab = t.labels(side)
        # a face rule of "more than zero" needs max_faces below one but above the switch-off value
        kept = E.drop_border_objects(lab, t.volumes, 0.5, True)
        parts.append(O.voxel_count(kept).select(F.lit(side).alias("side"), "volume_id", "label", F.col("volume_vx").alias("n")))
    return parts[0].unionByName(parts[1])


@query("evl_16_metric_pivot", """WITH s AS (SELECT l_suppkey file, l_returnflag model, l_discount ap FROM lineitem),
  w AS (SELECT file, avg(ap) FILTER (model='A') A, avg(ap) FILTER (model='N') N, avg(ap) FILTER (model='R') R FROM s GROUP BY 1)
  SELECT file, round(A,6) A, round(N,6) N, round(R,6) R, round((coalesce(A,0)+coalesce(N,0)+coalesce(R,0))/((A IS NOT NULL)::INT+(N IS NOT NULL)::INT+(R IS NOT NULL)::INT),6) mean_score FROM w""")
def _(t):
    s = t.table("lineitem").selectExpr("l_suppkey file", "l_returnflag model", "l_discount ap")
    wide = E.metric_pivot(s, "file", "model", ["A", "N", "R"], "ap")
    return rounded(wide, "A", "N", "R", "mean_score").orderBy("mean_score")


@query("evl_17_dice_reductions", f"""{VOX}, s AS (SELECT volume_id, y//8 py, x//8 px, sum(fg*m*(gt>0)::INT) i, sum(fg*fg*m+m*(gt>0)::INT) s FROM (SELECT *, (state<>2)::INT m FROM vox) GROUP BY 1,2,3)
  SELECT volume_id, round(1-2*sum(i)/greatest(sum(s),1e-7::DOUBLE),6) pooled_loss, round(avg(1-2*i/greatest(s,1e-7::DOUBLE)),6) per_sample_loss FROM s GROUP BY 1""")
def _(t):
    loss, _ = L.state_masks(F.col("state"))
    m = loss.cast("double")
    v = t.vox.select("volume_id", F.concat_ws("_", F.floor(F.col("y") / 8), F.floor(F.col("x") / 8)).alias("patch"),
                     (F.col("fg") * m).alias("p"), (G().cast("double") * m).alias("t"))
    return rounded(E.dice_reductions(v, "volume_id", "patch", "p", "t"), "pooled_loss", "per_sample_loss")
