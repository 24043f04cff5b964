"""Neighbourhood, iterative and resampling queries."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.fixtures import VOX
from voxelloom.operators import blocks as B
from voxelloom.operators import components as C
from voxelloom.operators import distance as D
from voxelloom.operators import edit as ED
from voxelloom.operators import gaps as G
from voxelloom.operators import labels as L
from voxelloom.operators import morphology as M
from voxelloom.operators import objects as O
from voxelloom.operators import resample as R
from voxelloom.operators import watershed as W
from voxelloom.plans.measure import SMALL_BLOCK, rounded
from voxelloom.plans.registry import query
from voxelloom.session import cut

VK = ["volume_id", "z", "y", "x"]
RVOX = VOX.replace("WITH ", "WITH RECURSIVE ", 1)
KEY = "((z::BIGINT<<42)+(y<<21)+x)"


def cc_sql(src: str, conn: int, same: bool = True, extra: str = "", tag: str = "") -> str:
    """Component CTEs ``cc{tag}(volume_id[, extra], k, root)`` over ``src`` rows."""
    offs = [o for o in L.offsets(conn)]
    keys = "volume_id" + (", " + extra if extra else "")
    match = " AND a.label=b.label" if same else ""
    pick = f"a.volume_id" + (f", a.{extra}" if extra else "")
    on = "a.volume_id=b.volume_id" + (f" AND a.{extra}=b.{extra}" if extra else "")
    return f"""cm{tag} AS (SELECT *, {KEY} k FROM {src}),
 ce{tag} AS (SELECT {pick}, a.k ka, b.k kb FROM cm{tag} a, (VALUES {','.join(str(o) for o in offs)}) o(dz,dy,dx), cm{tag} b
   WHERE {on} AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx{match}),
 cc{tag}({keys}, k, root) USING KEY ({keys}, k) AS (SELECT {keys}, k, k FROM cm{tag} UNION
   SELECT {', '.join('u.' + c for c in keys.split(', '))}, u.k, min(v.root) FROM recurring.cc{tag} u JOIN ce{tag} e ON e.ka=u.k AND {' AND '.join(f'e.{c}=u.{c}' for c in keys.split(', '))}
     JOIN cc{tag} v ON v.k=e.kb AND {' AND '.join(f'v.{c}=e.{c}' for c in keys.split(', '))} WHERE v.root<u.root GROUP BY ALL)"""


# ------------------------------------------------------------------ grids and halos
@query("vol_1_block_grid", f"""{VOX}, g AS (SELECT volume_id, nz, ny, nx, unnest(range(0,nz,2)) z0 FROM vol), h AS (SELECT *, unnest(range(0,ny,12)) y0 FROM g), i AS (SELECT *, unnest(range(0,nx,12)) x0 FROM h)
  SELECT volume_id, z0, least(nz,z0+2) z1, y0, least(ny,y0+12) y1, x0, least(nx,x0+12) x1 FROM i""")
def _(t):
    return B.block_grid(t.volumes, (2, 12, 12)).select("volume_id", "z0", "z1", "y0", "y1", "x0", "x1")


@query("vol_1_tiles", f"""{VOX}, g AS (SELECT volume_id, nz, ny, nx, unnest(range(0,ny,8)) y0 FROM vol), i AS (SELECT *, unnest(range(0,nx,8)) x0 FROM g), j AS (SELECT *, unnest(range(0,nz,2)) z0 FROM i)
  SELECT volume_id, greatest(0,z0-1) oz0, least(nz,z0+2+1) oz1, greatest(0,y0-4) oy0, least(ny,least(ny,y0+8)+4) oy1, greatest(0,x0-4) ox0, least(nx,least(nx,x0+8)+4) ox1 FROM j""")
def _(t):
    return B.tile_grid(t.volumes, (4, 16, 16), (1, 4, 4)).select("volume_id", "oz0", "oz1", "oy0", "oy1", "ox0", "ox1")


@query("vol_1_crops", f"""{VOX}, g AS (SELECT volume_id, nz, ny, nx, unnest(range(0,greatest(0,nz-2)+1,1)) z0 FROM vol), h AS (SELECT *, unnest(range(0,greatest(0,ny-16)+1,8)) y0 FROM g), i AS (SELECT *, unnest(range(0,greatest(0,nx-16)+1,8)) x0 FROM h)
  SELECT volume_id, z0, least(nz,z0+2) z1, y0, least(ny,y0+16) y1, x0, least(nx,x0+16) x1 FROM i""")
def _(t):
    return B.crop_grid(t.volumes, (2, 16, 16), (1, 8, 8)).select("volume_id", "z0", "z1", "y0", "y1", "x0", "x1")


@query("vol_1_budget_block", f"{VOX} SELECT volume_id, greatest(1,least(nz,2500//(ny*nx))) block_z FROM vol")
def _(t):
    return B.budget_block(t.volumes, 2500).select("volume_id", "block_z")


@query("udtf_1_volume_tiles", f"""{VOX}, g AS (SELECT volume_id, nz, ny, nx, unnest(range(0,nz,3)) z0 FROM vol) SELECT volume_id, z0, CASE WHEN nz-z0<6 AND nz%3>0 AND nz%3<2 AND z0+3>=nz-nz%3 THEN nz ELSE least(nz,z0+3) END z1
  FROM g WHERE NOT (nz%3>0 AND nz%3<2 AND nz>3 AND z0=nz-nz%3)""")
def _(t):
    return B.block_grid(t.volumes, (3, 64, 64), min_tail=2).select("volume_id", "z0", "z1")


@query("vol_2_halo_box_sum", f"""{VOX} SELECT a.volume_id, a.z, a.y, a.x, a.raw::DOUBLE raw, sum(b.raw)::DOUBLE box_sum FROM vox a JOIN vox b ON a.volume_id=b.volume_id AND abs(a.z-b.z)<=1
   AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY ALL""")
def _(t):
    return ED.identity_halo(t.vox, "raw", 1, SMALL_BLOCK)


# ------------------------------------------------------------------ components
FRAG = f"{RVOX}, frag AS (SELECT volume_id, z, y, x, gt AS label FROM vox WHERE gt>0 AND raw<150)"


def frag(t):
    return t.vox.where("gt > 0 and raw < 150").select(*VK, F.col("gt").alias("label"))


def component_table(df):
    return df.groupBy("volume_id", "label", "component").agg(F.count(F.lit(1)).alias("size"))


@query("vol_3_components_same_value", f"{FRAG}, {cc_sql('frag', 6)} SELECT c.volume_id, label, root component, count(*) size FROM cc c JOIN cm m ON m.k=c.k AND m.volume_id=c.volume_id GROUP BY 1,2,3")
def _(t):
    return component_table(C.components(frag(t), 6, True, SMALL_BLOCK))


@query("vol_3_components_foreground", f"""{RVOX}, fgm AS (SELECT volume_id, z, y, x, 1 AS label FROM vox WHERE fg>0.7 OR raw%16=0), {cc_sql('fgm', 18, False)} SELECT volume_id, root component, count(*) size FROM cc GROUP BY 1,2""")
def _(t):
    mask = t.vox.where("fg > 0.7 or raw % 16 = 0").select(*VK, F.lit(1).cast("long").alias("label"))
    return C.component_sizes(C.components(mask, 18, False, SMALL_BLOCK))


_SIZES = "sz AS (SELECT m.volume_id, label, root, count(*) n FROM cc c JOIN cm m ON m.k=c.k AND m.volume_id=c.volume_id GROUP BY 1,2,3)"


@query("vol_4_largest_component", f"""{FRAG}, {cc_sql('frag', 6)}, {_SIZES}, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume_id,label ORDER BY n DESC, root) r FROM sz) WHERE r=1)
  SELECT m.volume_id, m.z, m.y, m.x, m.label FROM cm m JOIN cc c ON c.k=m.k AND c.volume_id=m.volume_id JOIN tp ON tp.volume_id=m.volume_id AND tp.root=c.root""")
def _(t):
    return C.largest_per_label(frag(t), 6, block=SMALL_BLOCK)


@query("vol_5_drop_small_components", f"""{FRAG}, {cc_sql('frag', 6)}, {_SIZES} SELECT m.volume_id, m.z, m.y, m.x, m.label FROM cm m JOIN cc c ON c.k=m.k AND c.volume_id=m.volume_id
   JOIN sz ON sz.volume_id=m.volume_id AND sz.root=c.root AND n>=10""")
def _(t):
    return C.drop_small_components(frag(t), 10, True, 6, SMALL_BLOCK)


@query("vol_6_size_filter", f"{VOX} SELECT volume_id, z, y, x, pred AS label FROM vox WHERE (volume_id,pred) IN (SELECT (volume_id,pred) FROM vox WHERE pred>0 GROUP BY volume_id, pred HAVING count(*)>=120)")
def _(t):
    return C.size_filter(t.labels("pred"), 120)


@query("vol_7_zero_patches", f"""{RVOX}, pm AS (SELECT volume_id, z, y, x, 1 AS label FROM vox WHERE raw>=200), {cc_sql('pm', 6, False)}, big AS (SELECT volume_id, root FROM cc GROUP BY 1,2 HAVING count(*)>=5)
  SELECT v.volume_id, z, y, x, CASE WHEN b.root IS NOT NULL THEN 0 ELSE raw END raw FROM vox v LEFT JOIN cc c ON c.volume_id=v.volume_id AND c.k=((v.z::BIGINT<<42)+(v.y<<21)+v.x) AND raw>=200 LEFT JOIN big b ON b.volume_id=c.volume_id AND b.root=c.root""")
def _(t):
    return C.zero_patches(t.vox.select(*VK, "raw"), "raw", F.col("raw") >= 200, 5, 6, SMALL_BLOCK)


@query("vol_7_largest_patch", f"""{RVOX}, pm AS (SELECT volume_id, z, y, x, 1 AS label FROM vox WHERE raw>=200), {cc_sql('pm', 6, False)},
  big AS (SELECT volume_id, root FROM (SELECT volume_id, root, row_number() OVER (PARTITION BY volume_id ORDER BY count(*) DESC, root) r FROM cc GROUP BY 1,2) WHERE r=1)
  SELECT volume_id, root component, count(*) size FROM cc SEMI JOIN big USING (volume_id,root) GROUP BY 1,2""")
def _(t):
    v = t.vox.select(*VK, "raw").withColumn("old", F.col("raw"))
    dark = C.zero_patches(v, "raw", F.col("raw") >= 200, None, 6, SMALL_BLOCK).where("raw = 0 and old >= 200")
    return dark.groupBy("volume_id").agg(F.min(C.pack(F.col("z"), F.col("y"), F.col("x"))).alias("component"), F.count(F.lit(1)).alias("size"))


# ------------------------------------------------------------------ distance and watershed
DIST = """dm AS (SELECT volume_id, z, y, x FROM vox WHERE gt>0),
 dg AS (SELECT volume_id, z, y, x FROM (SELECT volume_id, z, y, unnest(range(0,nx)) x FROM (SELECT volume_id, nx, z, unnest(range(0,ny)) y FROM
   (SELECT volume_id, nx, ny, unnest(range(0,nz)) z FROM vol))) ANTI JOIN dm USING (volume_id,z,y,x)),
 dd AS (SELECT a.volume_id, a.z, a.y, a.x, min(sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) dist FROM dm a JOIN dg b ON a.volume_id=b.volume_id
   AND abs(a.y-b.y)<=6 AND abs(a.x-b.x)<=6 GROUP BY 1,2,3,4)"""


def dist(t, radius=4):
    return D.distance(t.vox.where("gt > 0"), t.volumes, radius, block=SMALL_BLOCK)


@query("vol_8_distance", f"{VOX}, {DIST} SELECT volume_id, z, y, x, round(dist,6) dist FROM dd")
def _(t):
    return rounded(dist(t), "dist")


@query("vol_9_seeds", f"""{RVOX}, {DIST}, sd AS (SELECT volume_id, z, y, x, 1 AS label FROM dd JOIN vox USING (volume_id,z,y,x) WHERE dist>1.5 AND fg>0.6), {cc_sql('sd', 6, False)} SELECT volume_id, root component, count(*) size FROM cc GROUP BY 1,2""")
def _(t):
    d = dist(t).join(t.vox.select(*VK, "fg"), VK).where("dist > 1.5 and fg > 0.6")
    return C.component_sizes(C.components(d.select(*VK, F.lit(1).cast("long").alias("label")), 6, False, SMALL_BLOCK))


@query("vol_10_height_map", f"""{VOX}, {DIST}, dx AS (SELECT volume_id, max(dist) m FROM dd GROUP BY 1)
  SELECT v.volume_id, v.z, v.y, v.x, round(CASE WHEN raw/255.0::DOUBLE>0.6 AND fg<0.6 THEN 2.0 ELSE (m-coalesce(dist,0))/m END,6) height FROM vox v JOIN dx USING (volume_id) LEFT JOIN dd USING (volume_id,z,y,x)""")
def _(t):
    v = t.vox.select(*VK, "fg", (F.col("raw") / 255.0).alias("bd"))
    h = D.height_map(v, dist(t), "fg", "bd", 2.0, bd_threshold=0.6)
    return rounded(h.select(*VK, "height"), "height")


def probabilities(t):
    """Foreground as given and a boundary channel that is low inside objects."""
    return t.vox.select(*VK, "fg", F.expr("case when gt > 0 then (raw % 40) / 200.0D else 0.3D + (raw % 60) / 100.0D end").alias("bd"))


@query("vol_11_watershed")
def _(t):
    v = probabilities(t)
    seeds = t.vox.where("gt > 0 and raw < 20").select(*VK, F.col("gt").alias("label"))
    out = W.watershed(v.withColumn("height", F.col("bd")).where("fg + bd > 0.5"), seeds, SMALL_BLOCK)
    return out.groupBy("volume_id", "label").agg(F.count(F.lit(1)).alias("size"), F.min("z").alias("z0"), F.min("y").alias("y0"), F.min("x").alias("x0"))


@query("vol_12_segment_axon", f"""{RVOX}, am AS (SELECT volume_id, z, y, x, 1 AS label FROM vox WHERE fg>0.6), {cc_sql('am', 26, False)} SELECT volume_id, root+1 AS label, count(*) size FROM cc GROUP BY 1,2 HAVING count(*)>=40""")
def _(t):
    p = W.SegParams(fg_threshold=0.6, seed_distance=None, min_size=40, flood=False)
    return O.voxel_count(W.segment(probabilities(t), t.volumes, p, block=SMALL_BLOCK)).withColumnRenamed("volume_vx", "size")


@query("vol_12_segment_objects")
def _(t):
    p = W.SegParams(seed_distance=1.2, min_size=20)
    return O.voxel_count(W.segment(probabilities(t), t.volumes, p, radius=3, block=SMALL_BLOCK))


@query("vol_12_presets")
def _(t):
    """Every named parameter set, with sizes that suit these small volumes: objects and voxels per volume."""
    v, parts, known = cut(probabilities(t)), [], {}
    for name, preset in W.PRESETS.items():
        p = replace(preset, min_size=min(preset.min_size, 20), seed_min_size=min(preset.seed_min_size, 3),
                    seed_distance=preset.seed_distance and 1.2, clean=preset.clean and (8, 1, 1))
        if p.flood and p.height == "distance" and p.bd_threshold not in known:
            known[p.bd_threshold] = W.boundary_distance(v, t.volumes, p, 3, SMALL_BLOCK)
        found = W.segment(v, t.volumes, p, radius=3, block=SMALL_BLOCK, dist=known.get(p.bd_threshold)).groupBy("volume_id").agg(
            F.countDistinct("label").alias("objects"), F.count(F.lit(1)).alias("voxels"))
        parts.append(t.volumes.select(F.lit(name).alias("preset"), "volume_id").join(found, "volume_id", "left").fillna(0, ["objects", "voxels"]))
    return reduce(DataFrame.unionByName, parts).select("preset", "volume_id", "objects", "voxels")


@query("vol_13_grow_labels", f"""{VOX}, s AS (SELECT volume_id, z, y, x, gt label FROM vox WHERE gt>0 AND raw<30), m AS (SELECT volume_id, z, y, x FROM vox WHERE gt>0 OR pred>0),
  d AS (SELECT m.*, label, (m.z-s.z)*(m.z-s.z)+(m.y-s.y)*(m.y-s.y)+(m.x-s.x)*(m.x-s.x) q FROM m JOIN s USING (volume_id))
  SELECT volume_id, z, y, x, label FROM (SELECT *, row_number() OVER (PARTITION BY volume_id,z,y,x ORDER BY q, label) r FROM d) WHERE r=1""")
def _(t):
    seeds = t.vox.where("gt > 0 and raw < 30").select(*VK, F.col("gt").alias("label"))
    return D.grow_labels(seeds, t.vox.where("gt > 0 or pred > 0"))


# ------------------------------------------------------------------ morphology
def _v(offs):
    return "(VALUES " + ",".join(str(o) for o in offs) + ") o(dz,dy,dx)"


def dilate_sql(src, elem, out):
    return f"""{out} AS (SELECT DISTINCT s.volume_id, s.z+dz z, s.y+dy y, s.x+dx x FROM {src} s JOIN vol USING (volume_id), {_v(elem)} WHERE s.z+dz BETWEEN 0 AND nz-1 AND s.y+dy BETWEEN 0 AND ny-1 AND s.x+dx BETWEEN 0 AND nx-1)"""


def erode_sql(src, elem, out):
    return f"""{out} AS (SELECT volume_id, z, y, x FROM (SELECT s.volume_id, s.z-dz z, s.y-dy y, s.x-dx x FROM {src} s, {_v(elem)}) GROUP BY 1,2,3,4 HAVING count(*)={len(elem)})"""


DISK, CROSS, ZLINE = M.element("disk", 2), M.element("cross"), M.element("zline")
_GM = "gm AS (SELECT volume_id, z, y, x FROM vox WHERE gt>0)"


def gt_mask(t):
    return t.vox.where("gt > 0").select(*VK)


@query("vol_14_erode", f"{VOX}, {_GM}, {erode_sql('gm', DISK, 'e')} SELECT * FROM e")
def _(t):
    return M.morph(gt_mask(t), M.volume_boxes(t.volumes), "erode", DISK, 1, SMALL_BLOCK)


@query("vol_14_dilate", f"{VOX}, {_GM}, {dilate_sql('gm', CROSS, 'd1')}, {dilate_sql('d1', CROSS, 'd2')} SELECT * FROM d2")
def _(t):
    return M.morph(gt_mask(t), M.volume_boxes(t.volumes), "dilate", CROSS, 2, SMALL_BLOCK)


@query("vol_14_close", f"{VOX}, {_GM}, {dilate_sql('gm', CROSS, 'd')}, {erode_sql('d', CROSS, 'e')} SELECT * FROM e")
def _(t):
    return M.morph(gt_mask(t), M.volume_boxes(t.volumes), "close", CROSS, 1, SMALL_BLOCK)


@query("vol_14_z_line", f"{VOX}, {_GM}, {dilate_sql('gm', ZLINE, 'd')} SELECT * FROM d")
def _(t):
    return M.morph(gt_mask(t), M.volume_boxes(t.volumes), "dilate", ZLINE, 1, SMALL_BLOCK)


@query("vol_15_clean_objects")
def _(t):
    return M.clean_objects(frag(t), 30, 1, 2, SMALL_BLOCK)


_HOLES = f"""bx AS (SELECT volume_id, label, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM frag GROUP BY 1,2),
 bg AS (SELECT volume_id, label, z, y, x FROM (SELECT volume_id, label, z, y, unnest(range(x0,x1+1)) x FROM (SELECT volume_id, label, x0, x1, z, unnest(range(y0,y1+1)) y FROM
   (SELECT volume_id, label, x0, x1, y0, y1, unnest(range(z0,z1+1)) z FROM bx))) ANTI JOIN frag USING (volume_id,label,z,y,x))"""


def fill_sql(limit, per_slice):
    edge = cc_sql("bg", 6, True, "label")
    if per_slice:
        edge = edge.replace("AND b.z=a.z+dz", "AND dz=0 AND b.z=a.z")
    return f"""{_HOLES}, {edge}, hs AS (SELECT volume_id, label, root FROM cc GROUP BY 1,2,3 HAVING count(*)<{limit}),
 fill AS (SELECT m.volume_id, m.z, m.y, m.x, m.label FROM cm m JOIN cc c ON c.volume_id=m.volume_id AND c.label=m.label AND c.k=m.k JOIN hs h ON h.volume_id=c.volume_id AND h.label=c.label AND h.root=c.root)"""


@query("vol_16_fill_holes", f"""{FRAG}, {fill_sql(6, False)} SELECT volume_id, z, y, x, max(label) label FROM (SELECT volume_id,z,y,x,label FROM frag UNION ALL SELECT volume_id,z,y,x,label FROM fill) GROUP BY 1,2,3,4""")
def _(t):
    return M.fill_holes(frag(t), 6, block=SMALL_BLOCK)


@query("vol_16_fill_holes_slices", f"""{FRAG}, {fill_sql(5, True)} SELECT volume_id, z, y, x, max(label) label FROM (SELECT volume_id,z,y,x,label FROM frag UNION ALL SELECT volume_id,z,y,x,label FROM fill) GROUP BY 1,2,3,4""")
def _(t):
    return M.fill_holes(frag(t), 4, per_slice=True, inclusive=True, block=SMALL_BLOCK)


@query("vol_17_fill_z_gaps", f"""{VOX}, m AS (SELECT volume_id, z, y, x FROM vox WHERE gt>0 AND raw<100 AND (z=0 OR (z=3 AND volume_id%2=0) OR (z=2 AND volume_id%2=1))),
  u AS (SELECT DISTINCT volume_id, z FROM m), s AS (SELECT volume_id, unnest(range(0,nz)) z FROM vol), g AS (SELECT s.volume_id, s.z, (SELECT max(z) FROM u WHERE u.volume_id=s.volume_id AND u.z<s.z) b,
   (SELECT min(z) FROM u WHERE u.volume_id=s.volume_id AND u.z>s.z) a FROM s ANTI JOIN u USING (volume_id,z))
  SELECT volume_id, z, y, x FROM m UNION SELECT g.volume_id, g.z, m.y, m.x FROM g JOIN m ON m.volume_id=g.volume_id AND (m.z=g.a OR m.z=g.b) WHERE a IS NOT NULL AND b IS NOT NULL AND a-b-1<=2""")
def _(t):
    m = t.vox.where("gt > 0 and raw < 100 and (z = 0 or (z = 3 and volume_id % 2 = 0) or (z = 2 and volume_id % 2 = 1))").select(*VK)
    return G.fill_z_gaps(m, t.volumes, 2)


@query("vol_18_merge_segmentations", f"""{VOX}, p AS (SELECT volume_id, gt, pred, count(*) n FROM vox WHERE gt>0 AND pred>0 GROUP BY 1,2,3), s2 AS (SELECT volume_id, pred, count(*) n2 FROM vox WHERE pred>0 GROUP BY 1,2),
  gone AS (SELECT DISTINCT volume_id, gt FROM p JOIN s2 USING (volume_id,pred) WHERE n/n2::DOUBLE>0.6), top AS (SELECT volume_id, max(gt) t FROM vox GROUP BY 1),
  ids AS (SELECT volume_id, pred, t+row_number() OVER (PARTITION BY volume_id ORDER BY pred) nid FROM s2 JOIN top USING (volume_id))
  SELECT v.volume_id, z, y, x, coalesce(nid, CASE WHEN g.gt IS NULL THEN v.gt END) label FROM vox v LEFT JOIN ids USING (volume_id,pred) LEFT JOIN gone g ON g.volume_id=v.volume_id AND g.gt=v.gt
  WHERE nid IS NOT NULL OR (v.gt>0 AND g.gt IS NULL)""")
def _(t):
    return ED.merge_segmentations(t.labels("gt"), t.labels("pred"), 0.6)


@query("vol_19_keep_with_inner", f"""{VOX}, i AS (SELECT DISTINCT volume_id, pred FROM vox WHERE pred>0 AND raw=9) SELECT volume_id, z, y, x, CASE WHEN i.pred IS NULL THEN 2 ELSE 1 END::BIGINT state FROM vox v LEFT JOIN i USING (volume_id,pred) WHERE v.pred>0""")
def _(t):
    return ED.object_states(t.labels("pred"), t.vox.where("raw = 9"))


@query("vol_20_additional_objects", f"""{VOX}, p AS (SELECT volume_id, gt, pred, count(*) n FROM vox WHERE gt>0 AND pred>0 GROUP BY 1,2,3), a AS (SELECT volume_id, gt, count(*) na FROM vox WHERE gt>0 GROUP BY 1,2), b AS (SELECT volume_id, pred, count(*) nb FROM vox WHERE pred>0 GROUP BY 1,2),
  m AS (SELECT DISTINCT volume_id, pred FROM p JOIN a USING (volume_id,gt) JOIN b USING (volume_id,pred) WHERE n/(na+nb-n)::DOUBLE>0.6), r AS (SELECT volume_id, pred, dense_rank() OVER (PARTITION BY volume_id ORDER BY pred) label FROM b ANTI JOIN m USING (volume_id,pred))
  SELECT volume_id, z, y, x, label FROM vox JOIN r USING (volume_id,pred)""")
def _(t):
    return ED.additional_objects(t.vox, "gt", "pred", 0.6)


_LINK = f"""{RVOX}, sl AS (SELECT volume_id, z, y, x, gt FROM vox WHERE gt>0 AND raw<200), nd AS (SELECT *, (z::BIGINT<<42)+dense_rank() OVER (PARTITION BY volume_id, z ORDER BY gt) node FROM sl), ns AS (SELECT volume_id, node, count(*) n FROM nd GROUP BY 1,2),
 pr AS (SELECT a.volume_id, a.node a, b.node b, count(*) o FROM nd a JOIN nd b ON a.volume_id=b.volume_id AND b.z=a.z+1 AND a.y=b.y AND a.x=b.x GROUP BY 1,2,3),
 ed AS (SELECT p.volume_id, a, b FROM pr p JOIN ns x ON x.volume_id=p.volume_id AND x.node=a JOIN ns y ON y.volume_id=p.volume_id AND y.node=b WHERE o/(x.n+y.n-o)::DOUBLE>=0.6),
 e2 AS (SELECT volume_id, a, b FROM ed UNION SELECT volume_id, b, a FROM ed),
 lc(volume_id, node, root) USING KEY (volume_id, node) AS (SELECT volume_id, node, node FROM ns UNION SELECT u.volume_id, u.node, min(v.root) FROM recurring.lc u JOIN e2 e ON e.volume_id=u.volume_id AND e.a=u.node JOIN lc v ON v.volume_id=e.volume_id AND v.node=e.b WHERE v.root<u.root GROUP BY ALL)"""


@query("vol_21_link_slices", f"""{_LINK} SELECT volume_id, root AS label, count(*) size FROM nd JOIN lc USING (volume_id,node) GROUP BY 1,2 HAVING max(z)-min(z)+1>=2""")
def _(t):
    out = ED.link_slices(t.vox.where("gt > 0 and raw < 200").select(*VK, F.col("gt").alias("label")), 0.6, 1, 2)
    return O.voxel_count(out).withColumnRenamed("volume_vx", "size")


@query("vol_22_average_predictions", f"{VOX} SELECT volume_id, z, y, x, round((fg+raw/255.0::DOUBLE+CASE WHEN pred>0 THEN 1 ELSE 0 END)/3,6) p FROM vox")
def _(t):
    parts = [t.vox.select(*VK, e.alias("p")) for e in (F.col("fg"), F.col("raw") / 255.0, (F.col("pred") > 0).cast("double"))]
    return rounded(ED.average_predictions(parts[0].unionByName(parts[1]).unionByName(parts[2]), "p"), "p")


@query("vol_23_split_stitch", f"{VOX} SELECT volume_id, z, y, x, gt FROM vox WHERE gt>0")
def _(t):
    tagged = ED.split_blocks(t.vox.where("gt > 0").select(*VK, "gt"), t.volumes, (2, 12, 12), min_tail=9)
    return ED.stitch_blocks(tagged).select(*VK, "gt")


_ADD = f"""{RVOX}, p AS (SELECT volume_id, gt, pred, count(*) n FROM vox WHERE gt>0 AND pred>0 GROUP BY 1,2,3), a AS (SELECT volume_id, gt, count(*) na FROM vox WHERE gt>0 GROUP BY 1,2), b AS (SELECT volume_id, pred, count(*) nb FROM vox WHERE pred>0 GROUP BY 1,2),
  mt AS (SELECT DISTINCT volume_id, pred FROM p JOIN a USING (volume_id,gt) JOIN b USING (volume_id,pred) WHERE n/(na+nb-n)::DOUBLE>0.6),
  un AS (SELECT volume_id, z, y, x, 1 AS label FROM vox v WHERE gt>0 OR (pred>0 AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.volume_id=v.volume_id AND mt.pred=v.pred)))"""


@query("vol_20_union_components", f"{_ADD}, {cc_sql('un', 26, False)} SELECT volume_id, root component, count(*) size FROM cc GROUP BY 1,2")
def _(t):
    return C.component_sizes(ED.add_missing(t.vox, "gt", "pred", 0.6, SMALL_BLOCK))


def _obj_erode(src, out):
    return f"{out} AS (SELECT volume_id, label, z, y, x FROM (SELECT s.volume_id, s.label, s.z-dz z, s.y-dy y, s.x-dx x FROM {src} s, {_v(CROSS)}) GROUP BY ALL HAVING count(*)={len(CROSS)})"


@query("vol_24_edits", f"""{FRAG}, {fill_sql(5, True)}, e0 AS (SELECT * FROM frag WHERE label%4=0),
  di AS (SELECT DISTINCT s.volume_id, s.label, s.z+dz z, s.y+dy y, s.x+dx x FROM e0 s JOIN vol USING (volume_id), {_v(CROSS)} WHERE s.z+dz BETWEEN 0 AND nz-1 AND s.y+dy BETWEEN 0 AND ny-1 AND s.x+dx BETWEEN 0 AND nx-1),
  e1 AS (SELECT * FROM frag WHERE label%4=1), {_obj_erode('e1', 'er')}, de AS (SELECT * FROM frag WHERE label%4=2 AND (volume_id,label) IN (SELECT (volume_id,label) FROM frag GROUP BY volume_id,label HAVING count(*)>=75)),
  fi AS (SELECT volume_id,label,z,y,x FROM frag WHERE label%4=3 UNION SELECT volume_id,label,z,y,x FROM fill WHERE label%4=3),
  al AS (SELECT volume_id,label,z,y,x FROM di UNION ALL SELECT volume_id,label,z,y,x FROM er UNION ALL SELECT volume_id,label,z,y,x FROM de UNION ALL SELECT volume_id,label,z,y,x FROM fi)
  SELECT volume_id, z, y, x, max(label) label FROM al GROUP BY 1,2,3,4""")
def _(t):
    lab = frag(t)
    op = F.element_at(F.array(*[F.lit(o) for o in ("dilate", "erode", "delete", "fill")]), (F.col("label") % 4 + 1).cast("int"))
    arg = F.element_at(F.array(*[F.lit(v) for v in (1, 1, 75, 4)]), (F.col("label") % 4 + 1).cast("int"))
    edits = lab.select("volume_id", "label").distinct().select("volume_id", "label", op.alias("op"), arg.alias("arg"), F.col("label").alias("seq"))
    return ED.apply_edits(lab, edits, t.volumes, SMALL_BLOCK)


# ------------------------------------------------------------------ resampling
@query("shp_1_stride", f"{VOX} SELECT volume_id, z, y//2 y, x//2 x, gt FROM vox WHERE y%2=0 AND x%2=0")
def _(t):
    return R.stride(t.vox.select(*VK, "gt"), (1, 2, 2))


def _axis_sql(rule):
    return ", ".join(f"i{a} AS (SELECT volume_id, o o{a}, CAST({rule.format(n='n' + a, t=s)} AS BIGINT) {a} FROM vol, range({s}) r(o))" for a, s in zip("zyx", (3, 20, 40)))


_RESAMPLED = "SELECT v.volume_id, oz z, oy y, ox x, gt FROM vox v JOIN iz USING (volume_id,z) JOIN iy USING (volume_id,y) JOIN ix USING (volume_id,x)"


@query("shp_2_pick_evenly", f"{VOX}, {_axis_sql('floor(o*({n}-1)/({t}-1.0::DOUBLE))')} {_RESAMPLED}")
def _(t):
    return R.pick_evenly(t.vox.select(*VK, "gt"), t.volumes, (3, 20, 40))


@query("shp_3_nearest", f"{VOX}, {_axis_sql('least(greatest(round_even(o*({n}/{t}::DOUBLE),0),0),{n}-1)')} {_RESAMPLED}")
def _(t):
    return R.nearest(t.vox.select(*VK, "gt"), t.volumes, (3, 20, 40))


@query("shp_4_box_mean", f"{VOX} SELECT volume_id, z//2 z, y//4 y, x//4 x, round(avg(raw),6) raw FROM vox GROUP BY 1,2,3,4")
def _(t):
    return rounded(R.box_mean(t.vox, (2, 4, 4), "raw"), "raw")


def _lin(a, s):
    at = f"greatest(0.0,least(n{a}-1.0,(o+0.5::DOUBLE)*n{a}/{s}-0.5))"
    return f"""l{a} AS (SELECT volume_id, o o{a}, floor({at})::BIGINT {a}, 1-({at}-floor({at})) w{a} FROM vol, range({s}) r(o)
      UNION ALL SELECT volume_id, o, floor({at})::BIGINT+1, {at}-floor({at}) FROM vol, range({s}) r(o))"""


@query("shp_4_linear", f"""{VOX}, {_lin('z', 3)}, {_lin('y', 20)}, {_lin('x', 24)} SELECT v.volume_id, oz z, oy y, ox x, round(sum(raw*wz*wy*wx),5)+0.0 raw
  FROM vox v JOIN lz USING (volume_id,z) JOIN ly USING (volume_id,y) JOIN lx USING (volume_id,x) GROUP BY ALL""")
def _(t):
    return rounded(R.linear(t.vox, t.volumes, (3, 20, 24), "raw"), "raw", digits=5)


def _smooth(a, s):
    """Per axis: Gaussian means of the mirrored line (g), then the linear weights (l) of ``_lin`` on them."""
    d = f"greatest(0.0,(n{a}::DOUBLE/{s}-1)/2)"
    bell = f"exp(-(k*k)/(2*({d})*({d})))"
    return f"""{_lin(a, s)}, k{a} AS (SELECT volume_id, n{a} n, i, k, CASE WHEN {d}=0 THEN 1.0 ELSE {bell} END b FROM vol, range(64) r(i), range(-200,201) q(k) WHERE i<n{a} AND abs(k)<=floor(4*{d}+0.5)),
      g{a} AS (SELECT volume_id, i, CASE WHEN m<n THEN m ELSE 2*(n-1)-m END s, sum(b)/any_value(t) w FROM (
        SELECT *, CASE WHEN n=1 THEN 0 ELSE (((i+k)%(2*(n-1)))+2*(n-1))%(2*(n-1)) END m, sum(b) OVER (PARTITION BY volume_id, i) t FROM k{a}) GROUP BY 1,2,3),
      h{a} AS (SELECT g.volume_id, o{a}, s {a}, sum(l.w{a}*g.w) w{a} FROM l{a} l JOIN g{a} g ON g.volume_id=l.volume_id AND g.i=l.{a} GROUP BY 1,2,3)"""


@query("shp_4_antialiased", f"""{VOX}, {_smooth('z', 2)}, {_smooth('y', 9)}, {_smooth('x', 12)} SELECT v.volume_id, oz z, oy y, ox x, round(sum(raw*wz*wy*wx),4)+0.0 raw
  FROM vox v JOIN hz USING (volume_id,z) JOIN hy USING (volume_id,y) JOIN hx USING (volume_id,x) GROUP BY ALL""")
def _(t):
    return rounded(R.antialiased(t.vox, t.volumes, (2, 9, 12), "raw"), "raw", digits=4)


@query("shp_5_rescale_plan", f"""{VOX} SELECT volume_id, nz, ny, nx, round_even(nz*(0.025::DOUBLE/0.010),0)::BIGINT out_nz, round_even(ny*(0.005::DOUBLE/0.010),0)::BIGINT out_ny, round_even(nx*(0.005::DOUBLE/0.010),0)::BIGINT out_nx,
  round(0.025/0.010::DOUBLE,6) ratio_z, 0.5::DOUBLE ratio_y, 0.5::DOUBLE ratio_x, false skipped FROM vol""")
def _(t):
    return rounded(R.rescale_plan(t.volumes, (0.025, 0.005, 0.005), (0.010, 0.010, 0.010)), "ratio_z", "ratio_y", "ratio_x")


@query("shp_6_align_common", f"""{VOX}, mx AS (SELECT max(nz) mz, max(ny) my, max(nx) mx FROM vol),
  {", ".join(f"i{a} AS (SELECT volume_id, o o{a}, CAST(least(greatest(round_even(o*(n{a}/m{a}::DOUBLE),0),0),n{a}-1) AS BIGINT) {a} FROM vol, mx, range(64) r(o) WHERE o<m{a})" for a in "zyx")} {_RESAMPLED}""")
def _(t):
    return R.align_to_common(t.vox.select(*VK, "gt"), t.volumes, F.lit(0))


@query("shp_7_pad_centred", f"{VOX} SELECT volume_id, z+CAST(ceil(greatest(0,7-nz)/2) AS BIGINT) z, y+CAST(ceil(greatest(0,37-ny)/2) AS BIGINT) y, x+CAST(ceil(greatest(0,40-nx)/2) AS BIGINT) x, gt FROM vox JOIN vol USING (volume_id) WHERE gt>0")
def _(t):
    return R.pad_centred(t.vox.where("gt > 0").select(*VK, "gt"), t.volumes, (7, 37, 40))


@query("shp_8_integer_scale", f"{VOX} SELECT volume_id, greatest(1,round_even((nz/2.0::DOUBLE+ny/16.0+nx/12.0)/3,0))::BIGINT scale, greatest(1,round_even(ny/12.0::DOUBLE,0))::BIGINT scale_y FROM vol")
def _(t):
    b = [F.lit(2.0), F.lit(16.0), F.lit(12.0)]
    return t.volumes.select("volume_id", R.integer_scale([F.col(n) for n in R.SHAPE], b).alias("scale"), R.axis_scale(F.col("ny"), F.lit(12.0)).alias("scale_y"))


# ------------------------------------------------------------------ user functions
@query("udf_1_group_transform", f"{VOX}, {_GM.replace('gt>0', 'gt IN (4,8,12,16)')}, {dilate_sql('gm', CROSS, 'd')} SELECT * FROM d")
def _(t):
    groups = {2: lambda m: M.morph(m, M.volume_boxes(t.volumes), "dilate", CROSS, 1, SMALL_BLOCK)}
    rows = L.group_channels(t.labels("gt"), t.label_groups)
    return groups[2](rows.where("group_id = 2").select(*VK))


@query("udf_2_virtual_volume", f"{VOX} SELECT volume_id, z, y, x, (fg+raw/510.0::DOUBLE)>0.5 AS mask FROM vox")
def _(t):
    virtual = lambda a, b: (a + b) > 0.5
    return t.vox.select(*VK, virtual(F.col("fg"), F.col("raw") / 510.0).alias("mask"))


@query("udf_3_block_function", f"""{VOX} SELECT a.volume_id, a.z, a.y, a.x, max(b.raw)::DOUBLE peak FROM vox a JOIN vox b ON a.volume_id=b.volume_id AND abs(a.z-b.z)<=1 AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY ALL""")
def _(t):
    def peak(arrays):
        raw = arrays["raw"]
        for axis in range(3):
            raw = np.maximum.reduce([np.roll(raw, k, axis) for k in (-1, 0, 1)])
        return {"peak": raw}
    return ED.map_with_halo(t.vox, peak, "peak double", {"raw": (np.float64, 0.0)}, 1, SMALL_BLOCK)


@query("udf_4_object_reducer", f"{VOX} SELECT volume_id, gt AS label, max(c) fullest_slice FROM (SELECT volume_id, gt, z, count(*) c FROM vox WHERE gt>0 GROUP BY 1,2,3) GROUP BY 1,2")
def _(t):
    def per_block(arrays, origin, inner, meta):
        counts = (arrays["gt"] > 0).sum(axis=(1, 2))
        return pd.DataFrame({"z": np.arange(len(counts)) + origin[0], "c": counts})[counts > 0]

    parts = O.reduce_objects(t.vox.where("gt > 0").withColumn("label", F.col("gt")), per_block, "z long, c long", {"gt": (np.int64, 0)}, SMALL_BLOCK)
    parts = parts.groupBy("volume_id", "label", "z").agg(F.sum("c").alias("c"))
    return parts.groupBy("volume_id", "label").agg(F.max("c").alias("fullest_slice"))


@query("udaf_1_mergeable_counts", f"{VOX} SELECT volume_id, gt AS label, count(*) n FROM vox WHERE gt>0 GROUP BY 1,2")
def _(t):
    blocks = B.with_blocks(t.labels("gt"), SMALL_BLOCK).groupBy("volume_id", "bz", "by", "bx", "label").agg(F.count(F.lit(1)).alias("c"))
    return blocks.groupBy("volume_id", "label").agg(F.sum("c").alias("n"))
