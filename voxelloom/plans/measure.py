"""Object and cell measurement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.fixtures import VOX, VOXEL_UM
from voxelloom.operators import cells as C
from voxelloom.operators import objects as O
from voxelloom.operators.lattice import config_table, crofton_weight, iso_area
from voxelloom.plans.registry import query
from voxelloom.session import cut

SMALL_BLOCK = (4, 32, 16)  # two blocks per fixture volume, so results cross block faces
SZ, SY, SX = VOXEL_UM
CUBE = SZ * SY * SX


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


def _r(expr, digits=6):
    return f"round({expr},{digits})"


# ------------------------------------------------------------------ SQL parts
OBJ = f"""{VOX}, lab AS (SELECT *, gt AS label FROM vox WHERE gt>0),
box AS (SELECT volume_id, label, count(*) volume_vx, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1
        FROM lab GROUP BY 1,2)"""

MOM = f"""{OBJ}, mom AS (SELECT volume_id, label, count(*) volume_vx,
  covar_samp(z*{SZ},z*{SZ}) a, covar_samp(y*{SY},y*{SY}) d, covar_samp(x*{SX},x*{SX}) f,
  covar_samp(z*{SZ},y*{SY}) b, covar_samp(z*{SZ},x*{SX}) c, covar_samp(y*{SY},x*{SX}) e
  FROM lab GROUP BY 1,2),
m2 AS (SELECT *, (a+d+f)/3 m FROM mom),
m3 AS (SELECT *, sqrt(((a-m)*(a-m)+(d-m)*(d-m)+(f-m)*(f-m)+2*(b*b+c*c+e*e))/6) p FROM m2),
m4 AS (SELECT *, CASE WHEN p=0 THEN NULL ELSE acos(greatest(-1.0,least(1.0,
  ((a-m)*((d-m)*(f-m)-e*e)-b*(b*(f-m)-e*c)+c*(b*e-(d-m)*c))/(2*p*p*p))))/3 END phi FROM m3),
m5 AS (SELECT *, CASE WHEN p=0 THEN m ELSE m+2*p*cos(phi) END l1,
  CASE WHEN p=0 THEN m ELSE m+2*p*cos(phi+2*pi()/3) END l3 FROM m4),
m6 AS (SELECT *, 3*m-l1-l3 l2 FROM m5),
ax AS (SELECT volume_id, label,
  CASE WHEN a IS NOT NULL THEN sqrt(CASE WHEN l1>1e-15 THEN l1 ELSE 0 END) END a_um,
  CASE WHEN a IS NOT NULL THEN sqrt(CASE WHEN l2>1e-15 THEN l2 ELSE 0 END) END b_um,
  CASE WHEN a IS NOT NULL THEN sqrt(CASE WHEN l3>1e-15 THEN l3 ELSE 0 END) END c_um FROM m6),
axes AS (SELECT *, CASE WHEN c_um<>0 THEN a_um/c_um END elongation_a_over_c,
  CASE WHEN c_um<>0 THEN b_um/c_um END flatness_b_over_c,
  CASE WHEN c_um<>0 AND a_um<>0 THEN c_um/a_um END isotropy_c_over_a FROM ax)"""

ASSIGN = """ctg AS (SELECT volume_id, label, cell, count(*) n FROM lab GROUP BY 1,2,3),
cid AS (SELECT volume_id, label, cell AS cell_id FROM (SELECT *, row_number() OVER (PARTITION BY volume_id,label ORDER BY n DESC, cell) r
        FROM ctg WHERE cell<>0) WHERE r=1)"""

_OFF = "(VALUES " + ",".join(f"({i})" for i in (0, 1)) + ")"
# Doubled-lattice keys of the closed cube complex, independent of the byte histogram.
EULER = """euler_k AS (
  SELECT DISTINCT volume_id, label, 2*z+dz kz, 2*y+dy ky, 2*x+dx kx, abs(dz)+abs(dy)+abs(dx) odd
  FROM lab, (VALUES (-1),(0),(1)) a(dz), (VALUES (-1),(0),(1)) b(dy), (VALUES (-1),(0),(1)) c(dx)),
euler AS (SELECT volume_id, label, CAST(sum(CASE odd WHEN 3 THEN 1 WHEN 2 THEN -1 WHEN 1 THEN 1 ELSE -1 END) AS BIGINT) euler_char
  FROM euler_k GROUP BY 1,2)"""

_ISO_VALUES = ",".join(f"({c},{iso_area(c, VOXEL_UM)!r}::DOUBLE)" for c in range(1, 255))
ISO = f"""isot(config, iso) AS (VALUES {_ISO_VALUES}),
corner AS (SELECT l.volume_id, label, z-dz cz, y-dy cy, x-dx cx, 1 << (4*dz+2*dy+dx) bit, nz, ny, nx
  FROM lab l JOIN vol USING (volume_id), (VALUES (0),(1)) a(dz), (VALUES (0),(1)) b(dy), (VALUES (0),(1)) c(dx)),
byte AS (SELECT volume_id, label, cz, cy, cx, CAST(sum(bit) AS INTEGER) config FROM corner
  WHERE cz BETWEEN 0 AND nz-2 AND cy BETWEEN 0 AND ny-2 AND cx BETWEEN 0 AND nx-2 GROUP BY ALL),
surf AS (SELECT volume_id, label, sum(iso) surface_um2 FROM byte JOIN isot USING (config) GROUP BY 1,2)"""

NND = f"""cen AS (SELECT volume_id, label, avg(z)*{SZ} cz, avg(y)*{SY} cy, avg(x)*{SX} cx FROM lab GROUP BY 1,2),
nnd AS (SELECT a.volume_id, a.label, min(sqrt((a.cz-b.cz)*(a.cz-b.cz)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cx-b.cx)*(a.cx-b.cx))) nearest_neighbor_um
  FROM cen a JOIN cen b ON a.volume_id=b.volume_id AND a.label<>b.label GROUP BY 1,2)"""

TOUCH = """touch AS (SELECT volume_id, label, (z0=0 OR z1=nz-1 OR y0=0 OR y1=ny-1 OR x0=0 OR x1=nx-1) touches_border,
  CAST(z0=0 AS BIGINT)+CAST(z1=nz-1 AS BIGINT)+CAST(y0=0 AS BIGINT)+CAST(y1=ny-1 AS BIGINT)+CAST(x0=0 AS BIGINT)+CAST(x1=nx-1 AS BIGINT) nf,
  CAST(y0=0 AS BIGINT)+CAST(y1=ny-1 AS BIGINT)+CAST(x0=0 AS BIGINT)+CAST(x1=nx-1 AS BIGINT) nf_xy
  FROM box JOIN vol USING (volume_id))"""

FULL = f"""{MOM}, {ASSIGN}, {EULER}, {ISO}, {NND}, {TOUCH},
inten AS (SELECT volume_id, label, avg(raw) mean_intensity, min(raw) min_intensity, max(raw) max_intensity,
  stddev_pop(raw) std_intensity, avg(z) centroid_z_vx, avg(y) centroid_y_vx, avg(x) centroid_x_vx FROM lab GROUP BY 1,2),
objects AS (SELECT b.volume_id, b.label label_id, cell_id, b.volume_vx, b.volume_vx*{CUBE} volume_um3, surface_um2,
  CASE WHEN surface_um2>0 THEN pow(pi(),1.0/3)*pow(6*b.volume_vx*{CUBE},2.0/3)/surface_um2 END sphericity,
  surface_um2/(b.volume_vx*{CUBE}) sv_ratio, a_um, b_um, c_um, elongation_a_over_c, flatness_b_over_c, isotropy_c_over_a,
  euler_char, touches_border, centroid_z_vx, centroid_y_vx, centroid_x_vx,
  centroid_z_vx*{SZ} centroid_z_um, centroid_y_vx*{SY} centroid_y_um, centroid_x_vx*{SX} centroid_x_um,
  nearest_neighbor_um, mean_intensity, min_intensity, max_intensity, std_intensity
  FROM box b LEFT JOIN axes USING (volume_id,label) LEFT JOIN cid USING (volume_id,label) LEFT JOIN euler USING (volume_id,label)
  LEFT JOIN surf USING (volume_id,label) LEFT JOIN nnd USING (volume_id,label) LEFT JOIN touch USING (volume_id,label)
  LEFT JOIN inten USING (volume_id,label))"""

CELLS = f"""cells AS (SELECT volume_id, cell cell_id, count(*)*{CUBE} cell_volume_um3 FROM vox WHERE cell>0 GROUP BY 1,2)"""
# The lean object table the cell queries need.
LEAN = f"""{MOM}, {ASSIGN}, {TOUCH}, {CELLS},
objects AS (SELECT b.volume_id, b.label label_id, cell_id, b.volume_vx*{CUBE} volume_um3, elongation_a_over_c,
  flatness_b_over_c, touches_border, (SELECT NULL) dummy, mi mean_intensity
  FROM box b LEFT JOIN axes USING (volume_id,label) LEFT JOIN cid USING (volume_id,label) LEFT JOIN touch USING (volume_id,label)
  LEFT JOIN (SELECT volume_id, label, avg(raw) mi FROM lab GROUP BY 1,2) USING (volume_id,label))"""
CELLAGG = """cagg AS (SELECT volume_id, cell_id, count(*) n, sum(volume_um3) v, avg(volume_um3) m FROM objects
  WHERE cell_id IS NOT NULL GROUP BY 1,2)"""
QC = f"""{LEAN}, clean AS (SELECT * FROM objects WHERE mean_intensity>=1 AND elongation_a_over_c<20),
qagg AS (SELECT volume_id, cell_id, count(*) n, sum(volume_um3) v FROM clean WHERE cell_id IS NOT NULL GROUP BY 1,2),
qcells AS (SELECT volume_id, cell_id, cell_volume_um3, coalesce(n,0) mito_count, coalesce(v,0) mito_volume_um3,
  coalesce(v,0)/cell_volume_um3 mito_volume_fraction FROM cells LEFT JOIN qagg USING (volume_id,cell_id)
  WHERE coalesce(n,0)>0 AND coalesce(v,0)/cell_volume_um3<=1)"""


def labels(t):
    return t.labels("gt", "raw", "cell")


def lean_objects(t):
    """Objects without neighbour search, in voxel-row aggregates only."""
    lab = labels(t)
    return O.object_core(lab, t.volumes, VOXEL_UM).join(O.assign_cell(lab), O.OBJECT, "left").select(
        "volume_id", F.col("label").alias("label_id"), "cell_id", "volume_um3", "elongation_a_over_c",
        "flatness_b_over_c", "touches_border", "mean_intensity")


def cells(t):
    return t.vox.where("cell > 0").groupBy("volume_id", F.col("cell").alias("cell_id")).agg(
        (F.count(F.lit(1)) * CUBE).alias("cell_volume_um3"))


def qc(t):
    # every fixture object spans all four slices, so the border rule stays off here
    clean = cut(C.qc_objects(lean_objects(t), exclude_border=False))
    return clean, cut(C.qc_cells(cells(t), clean))


# ------------------------------------------------------------------ OBJ
@query("obj_1_voxel_count", f"{OBJ} SELECT volume_id, label, volume_vx FROM box")
def _(t):
    return O.voxel_count(t.labels("gt"))


@query("obj_2_bounding_box", f"""{OBJ} SELECT volume_id, label, greatest(0,z0-1) z0, least(nz,z1+2) z1,
  greatest(0,y0-1) y0, least(ny,y1+2) y1, greatest(0,x0-1) x0, least(nx,x1+2) x1 FROM box JOIN vol USING (volume_id)""")
def _(t):
    return O.padded_box(O.bounding_box(t.labels("gt")), t.volumes, 1)


@query("obj_3_box_corners", f"""{OBJ}, u AS (SELECT volume_id, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1
  FROM vox WHERE gt>0 OR pred>0 GROUP BY 1)
  SELECT volume_id, CAST(4*i+2*j+k AS BIGINT) corner, CASE i WHEN 0 THEN z0 ELSE z1 END z, CASE j WHEN 0 THEN y0 ELSE y1 END y,
  CASE k WHEN 0 THEN x0 ELSE x1 END x FROM u, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j), (VALUES (0),(1)) c(k)""")
def _(t):
    return O.box_corners(O.bounding_box(t.vox.where("gt > 0 or pred > 0"), ["volume_id"]))


_CEN = [f"centroid_{a}_{u}" for a in "zyx" for u in ("vx", "um")]


@query("obj_4_centroid", f"""{OBJ} SELECT volume_id, label, {", ".join(
    f"round(avg({a}),6) centroid_{a}_vx, round(avg({a})*{s},6) centroid_{a}_um" for a, s in zip("zyx", VOXEL_UM))}
  FROM lab GROUP BY 1,2""")
def _(t):
    return rounded(O.centroid(t.labels("gt"), VOXEL_UM), *_CEN)


@query("obj_5_volume_density", f"""{OBJ}, f AS (SELECT volume_id, count(*) n_objects, sum(volume_vx)*{CUBE} v FROM box GROUP BY 1)
  SELECT volume_id, n_objects, round(v,9) object_um3, round(nz*ny*nx*{CUBE},9) analysis_um3,
  round(n_objects/(nz*ny*nx*{CUBE}),6) density_per_um3 FROM f JOIN vol USING (volume_id)""")
def _(t):
    o = O.voxel_count(t.labels("gt")).groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("n_objects"), (F.sum("volume_vx") * CUBE).alias("v"))
    whole = F.col("nz") * F.col("ny") * F.col("nx") * CUBE
    return o.join(t.volumes, "volume_id").select(
        "volume_id", "n_objects", F.round("v", 9).alias("object_um3"), F.round(whole, 9).alias("analysis_um3"),
        F.round(F.col("n_objects") / whole, 6).alias("density_per_um3"))


@query("obj_6_intensity", f"""{OBJ} SELECT volume_id, label, round(avg(raw),6) mean_intensity, min(raw) min_intensity,
  max(raw) max_intensity, round(stddev_pop(raw),6) std_intensity FROM lab GROUP BY 1,2""")
def _(t):
    return rounded(O.intensity(t.labels("gt", "raw")), "mean_intensity", "std_intensity")


_AX = ["a_um", "b_um", "c_um", "elongation_a_over_c", "flatness_b_over_c", "isotropy_c_over_a"]


@query("obj_7_principal_axes", f"{MOM} SELECT volume_id, label, {', '.join(_r(c) + ' ' + c for c in _AX)} FROM axes")
def _(t):
    return rounded(O.principal_axes(t.labels("gt"), VOXEL_UM), *_AX)


@query("obj_8_euler", f"{OBJ}, {EULER} SELECT volume_id, label, euler_char FROM euler")
def _(t):
    return O.lattice_measures(t.labels("gt"), t.volumes, VOXEL_UM, SMALL_BLOCK).select("volume_id", "label", "euler_char")


@query("obj_9_exposed_faces", f"""{OBJ}, side AS (SELECT volume_id, label, z+dz z, y+dy y, x+dx x, a FROM lab,
   (VALUES (1,0,0,{SY * SX!r}),(-1,0,0,{SY * SX!r}),(0,1,0,{SZ * SX!r}),(0,-1,0,{SZ * SX!r}),(0,0,1,{SZ * SY!r}),(0,0,-1,{SZ * SY!r})) o(dz,dy,dx,a))
  SELECT volume_id, label, count(*) exposed_faces, round(sum(a),9) exposed_area_um2 FROM side
  ANTI JOIN lab USING (volume_id,label,z,y,x) GROUP BY 1,2""")
def _(t):
    out = O.lattice_measures(t.labels("gt"), t.volumes, VOXEL_UM, SMALL_BLOCK)
    return rounded(out.select("volume_id", "label", "exposed_faces", "exposed_area_um2"), "exposed_area_um2", digits=9)


@query("obj_9_iso_surface", f"{OBJ}, {ISO} SELECT volume_id, label, round(surface_um2,9) surface_um2 FROM surf")
def _(t):
    out = O.lattice_measures(t.labels("gt"), t.volumes, VOXEL_UM, SMALL_BLOCK)
    return rounded(out.select("volume_id", "label", "surface_um2"), "surface_um2", digits=9)


@query("obj_10_sphericity", f"""{OBJ}, {ISO} SELECT volume_id, label,
  round(pow(pi(),1.0/3)*pow(6*volume_vx*{CUBE},2.0/3)/surface_um2,6) sphericity, round(surface_um2/(volume_vx*{CUBE}),4) sv_ratio
  FROM box LEFT JOIN surf USING (volume_id,label)""")
def _(t):
    lab = t.labels("gt")
    s = O.lattice_measures(lab, t.volumes, VOXEL_UM, SMALL_BLOCK).select(*O.OBJECT, "surface_um2")
    vol = F.col("volume_vx") * CUBE
    return O.voxel_count(lab).join(s, O.OBJECT, "left").select(
        *O.OBJECT, F.round(O.sphericity(vol, F.col("surface_um2")), 6).alias("sphericity"),
        F.round(O.ratio(F.col("surface_um2"), vol), 4).alias("sv_ratio"))


@query("obj_11_touches_border", f"{OBJ}, {TOUCH} SELECT volume_id, label, touches_border FROM touch")
def _(t):
    return O.touches_border(O.bounding_box(t.labels("gt")), t.volumes)


@query("obj_12_faces_touched", f"{OBJ}, {TOUCH} SELECT volume_id, label, nf faces_touched, nf_xy faces_touched_xy FROM touch")
def _(t):
    box = O.bounding_box(t.labels("gt"))
    flat = O.faces_touched(box, t.volumes, disregard_z=True).withColumnRenamed("faces_touched", "faces_touched_xy")
    return O.faces_touched(box, t.volumes).join(flat, O.OBJECT)


@query("obj_13_cell_assignment", f"""{OBJ}, {ASSIGN} SELECT volume_id, label, cell_id FROM box LEFT JOIN cid USING (volume_id,label)""")
def _(t):
    return O.assign_cell(labels(t))


@query("obj_14_majority_class", f"""{VOX}, p AS (SELECT volume_id, pred, gt, count(*) n FROM vox WHERE pred>0 GROUP BY 1,2,3),
  s AS (SELECT volume_id, pred, CAST(sum(n) AS BIGINT) size FROM p GROUP BY 1,2),
  r AS (SELECT *, row_number() OVER (PARTITION BY volume_id,pred ORDER BY n DESC, gt) k FROM p WHERE gt<>0)
  SELECT volume_id, pred, gt class_id, n overlap, size FROM r JOIN s USING (volume_id,pred) WHERE k=1 AND n>=0.5*size""")
def _(t):
    return O.majority_class(t.vox.where("pred > 0"), "pred", "gt", 0.5)


_CROFT = ",".join(f"({c},{crofton_weight(c)!r}::DOUBLE)" for c in range(16))


@query("obj_15_region_2d", f"""{OBJ}, w(config,wt) AS (VALUES {_CROFT}),
  q AS (SELECT volume_id, z, label, y-dy cy, x-dx cx, sum(1 << (2*dy+dx)) config FROM lab, (VALUES (0),(1)) a(dy), (VALUES (0),(1)) b(dx) GROUP BY ALL),
  per AS (SELECT volume_id, z, label, sum(wt) perimeter_px FROM q JOIN w ON w.config=q.config GROUP BY 1,2,3),
  sd AS (SELECT volume_id, z, label, y+dy y, x+dx x FROM lab, (VALUES (1,0),(-1,0),(0,1),(0,-1)) o(dy,dx)),
  fp AS (SELECT volume_id, z, label, count(*) face_perimeter_px FROM sd ANTI JOIN lab USING (volume_id,z,label,y,x) GROUP BY 1,2,3),
  bd AS (SELECT volume_id, z, label, count(*) area_px, round(avg(raw),6) mean_intensity, min(raw) min_intensity, max(raw) max_intensity
    FROM lab GROUP BY 1,2,3)
  SELECT bd.*, face_perimeter_px, round(perimeter_px,6) perimeter_px, round(area_px*25.0::DOUBLE,6) area_nm2, round(perimeter_px*5,6) perimeter_nm,
    round(4*pi()*area_px*25.0/pow(perimeter_px*5,2),6) circularity FROM bd JOIN per USING (volume_id,z,label) JOIN fp USING (volume_id,z,label)""")
def _(t):
    out = O.region_metrics_2d(labels(t), t.volumes, (5.0, 5.0), SMALL_BLOCK)
    return rounded(out, "perimeter_px", "area_nm2", "perimeter_nm", "circularity", "mean_intensity")


@query("obj_16_slice_prompts", f"""{OBJ} SELECT volume_id, z, label, round(avg(x),6) cx, round(avg(y),6) cy, count(*) area
  FROM lab GROUP BY 1,2,3 HAVING count(*)>=20""")
def _(t):
    return rounded(O.slice_prompts(t.labels("gt"), 20), "cx", "cy")


@query("obj_17_z_extent", f"{OBJ} SELECT volume_id, label, z1-z0+1 z_slices FROM box WHERE z1-z0+1>=2")
def _(t):
    return O.z_extent(O.bounding_box(t.labels("gt")), 2)


_UM9 = ["volume_um3", "surface_um2"]
_R6 = ["sphericity", *_AX, *_CEN, "nearest_neighbor_um", "mean_intensity", "std_intensity"]
_FULL_COLS = ["volume_id", "label_id", "cell_id", "volume_vx", "euler_char", "touches_border", "min_intensity", "max_intensity"]


def _full_select():
    parts = list(_FULL_COLS) + [f"{_r(c, 9)} {c}" for c in _UM9] + [f"{_r(c)} {c}" for c in _R6] + ["round(sv_ratio,4) sv_ratio"]
    return ", ".join(parts)


@query("obj_18_object_table", f"{FULL} SELECT {_full_select()} FROM objects")
def object_table(t):
    out = O.object_table(labels(t), t.volumes, VOXEL_UM, SMALL_BLOCK)
    return rounded(rounded(rounded(out, *_UM9, digits=9), *_R6), "sv_ratio", digits=4)


@query("obj_19_dataset_summary", f"""{OBJ}, {NND}, v AS (SELECT sum(nz*ny*nx)*{CUBE} tot FROM vol)
  SELECT count(*) n_objects, round(sum(volume_vx)*{CUBE},9) total_um3, round(count(*)/any_value(tot),6) density_per_um3,
  round(avg(nearest_neighbor_um),6) nnd_mean, round(median(nearest_neighbor_um),6) nnd_median
  FROM box LEFT JOIN nnd USING (volume_id,label), v""")
def _(t):
    from voxelloom.operators.ordered import exact_quantiles
    lab = t.labels("gt")
    cents = O.centroid(lab, VOXEL_UM)
    near = O.nearest_object(cents, 4 * max(VOXEL_UM))
    objs = O.voxel_count(lab).join(near, O.OBJECT, "left")
    head = objs.agg(F.count(F.lit(1)).alias("n_objects"), (F.sum("volume_vx") * CUBE).alias("total"),
                    F.avg("nearest_neighbor_um").alias("nnd_mean"))
    med = exact_quantiles(objs, [], "nearest_neighbor_um", [0.5], ["nnd_median"])
    whole = t.volumes.agg((F.sum(F.col("nz") * F.col("ny") * F.col("nx")) * CUBE).alias("whole"))
    one = F.lit(1).alias("_k")
    return (
        head.select("*", one).join(med.select("*", one), "_k", "left").join(whole.select("*", one), "_k")
        .select("n_objects", F.round("total", 9).alias("total_um3"),
                F.round(F.col("n_objects") / F.col("whole"), 6).alias("density_per_um3"),
                F.round("nnd_mean", 6).alias("nnd_mean"), F.round("nnd_median", 6).alias("nnd_median")))


@query("obj_20_rois", f"""{OBJ}, r AS (SELECT volume_id, label, greatest(0,least(z0,nz-2)) rz0, greatest(0,least(y0,ny-16)) ry0,
    greatest(0,least(x0,nx-16)) rx0 FROM box JOIN vol USING (volume_id))
  SELECT r.volume_id, r.label, rz0, ry0, rx0, count(*) n_foreground FROM r JOIN lab l ON l.volume_id=r.volume_id
    AND l.z>=rz0 AND l.z<rz0+2 AND l.y>=ry0 AND l.y<ry0+16 AND l.x>=rx0 AND l.x<rx0+16 GROUP BY ALL HAVING count(*)>=100""")
def _(t):
    return O.rois(t.labels("gt"), t.volumes, (2, 16, 16)).select("volume_id", "label", "rz0", "ry0", "rx0", "n_foreground")


# ------------------------------------------------------------------ AGG 1-5 and their joins
_CELLCOLS = ["volume_id", "cell_id"]


@query("agg_1_cell_table", f"""{LEAN}, {CELLAGG} SELECT volume_id, cell_id, round(cell_volume_um3,9) cell_volume_um3, coalesce(n,0) mito_count,
  round(coalesce(v,0),9) mito_volume_um3, round(coalesce(v,0)/cell_volume_um3,6) mito_volume_fraction, round(m,9) mito_mean_volume_um3,
  round(coalesce(n,0)/cell_volume_um3,6) mito_density_per_um3 FROM cells LEFT JOIN cagg USING (volume_id,cell_id)""")
def _(t):
    out = C.cell_table(cells(t), lean_objects(t))
    out = rounded(out, "cell_volume_um3", "mito_volume_um3", "mito_mean_volume_um3", digits=9)
    return rounded(out, "mito_volume_fraction", "mito_density_per_um3")


@query("agg_2_cell_summary_2d", f"""{VOX} SELECT volume_id, z, cell, count(*) cell_area, count(*) FILTER (gt>0) object_area,
  count(DISTINCT nullif(gt,0)) object_count, round(count(*) FILTER (gt>0)/count(*),6) object_ratio FROM vox WHERE cell>0 GROUP BY 1,2,3""")
def _(t):
    return rounded(C.cell_summary_2d(t.vox, "cell", "gt", ("volume_id", "z")), "object_ratio")


@query("agg_3_qc_filter", f"""{QC} SELECT volume_id, cell_id, round(cell_volume_um3,9) cell_volume_um3, mito_count,
  round(mito_volume_um3,9) mito_volume_um3, round(mito_volume_fraction,6) mito_volume_fraction FROM qcells""")
def _(t):
    return rounded(rounded(qc(t)[1], "cell_volume_um3", "mito_volume_um3", digits=9), "mito_volume_fraction")


@query("agg_3_qc_counts", f"""{QC.replace("WHERE mean", "WHERE NOT touches_border AND mean")} SELECT 'objects' AS kind, (SELECT count(*) FROM objects) n_before, (SELECT count(*) FROM clean) n_after
  UNION ALL SELECT 'cells', (SELECT count(*) FROM cells), (SELECT count(*) FROM qcells)""")
def _(t):
    objs, cl = cut(lean_objects(t)), cut(cells(t))
    clean = C.qc_objects(objs)
    good = C.qc_cells(cl, clean)
    n = F.count(F.lit(1))
    parts = [f.agg(n.alias("n")).select(F.lit(k).alias("kind"), F.lit(w).alias("w"), "n")
             for k, w, f in (("objects", 0, objs), ("objects", 1, clean), ("cells", 0, cl), ("cells", 1, good))]
    from voxelloom.operators.ordered import union_all
    return union_all(parts).groupBy("kind").agg(
        F.sum(F.when(F.col("w") == 0, F.col("n"))).alias("n_before"), F.sum(F.when(F.col("w") == 1, F.col("n"))).alias("n_after"))


MERGED = f"""{QC}, merged AS (SELECT c.*, q.cell_volume_um3, c.volume_um3/q.cell_volume_um3 frac FROM clean c JOIN qcells q USING (volume_id,cell_id)),
ml AS (SELECT volume_id, cell_id, avg(volume_um3) mv, median(volume_um3) dv, stddev_samp(volume_um3) sv, avg(frac) mf,
  avg(elongation_a_over_c) me, median(elongation_a_over_c) de, avg(flatness_b_over_c) ml, median(flatness_b_over_c) dl FROM merged GROUP BY 1,2)"""


@query("agg_4_cell_level_summary", f"""{MERGED} SELECT volume_id, cell_id, round(cell_volume_um3,9) cell_volume_um3, mito_count,
  round(mito_volume_um3,9) mito_volume_um3, round(mito_volume_fraction,6) mito_volume_fraction,
  round(mito_count/cell_volume_um3,6) mito_count_density, round(mito_volume_um3/cell_volume_um3,6) mito_volume_density,
  round(mv,9) mean_mito_volume_um3, round(dv,9) median_mito_volume_um3, round(sv,9) std_mito_volume_um3,
  round(mf,6) mean_single_mito_fraction_of_cell, round(me,6) mean_mito_elongation, round(de,6) median_mito_elongation,
  round(ml,6) mean_mito_flatness, round(dl,6) median_mito_flatness,
  round(log10(cell_volume_um3+1e-9),6) log10_cell_volume_um3, round(log10(mito_count+1e-9),6) log10_mito_count,
  round(log10(mito_count/cell_volume_um3+1e-9),6) log10_mito_count_density, round(log10(mito_volume_um3+1e-9),6) log10_mito_volume_um3,
  round(log10(mito_volume_um3/cell_volume_um3+1e-9),6) log10_mito_volume_density,
  round(log10(mv+1e-9),6) log10_mean_mito_volume_um3, round(log10(dv+1e-9),6) log10_median_mito_volume_um3
  FROM qcells JOIN ml USING (volume_id,cell_id)""")
def cell_summary(t):
    clean, good = qc(t)
    out = C.cell_level_summary(C.objects_in_cells(clean, good), good)
    nine = ["cell_volume_um3", "mito_volume_um3", "mean_mito_volume_um3", "median_mito_volume_um3", "std_mito_volume_um3"]
    six = [c for c in out.columns if c not in nine + ["volume_id", "cell_id", "mito_count"]]
    return rounded(rounded(out, *nine, digits=9), *six)


@query("agg_5_normalised_summary", f"""{LEAN}, {CELLAGG}, mg AS (SELECT o.*, volume_um3/cell_volume_um3 norm FROM objects o JOIN cells USING (volume_id,cell_id)
    JOIN cagg USING (volume_id,cell_id)),
  ag AS (SELECT volume_id, cell_id, count(*) num_mitos_annotated, round(avg(volume_um3),9) mean_mito_volume_um3, round(median(volume_um3),9) median_mito_volume_um3,
    round(stddev_samp(volume_um3),9) std_mito_volume_um3, round(avg(norm),6) mean_mito_size_norm, round(avg(elongation_a_over_c),6) mean_mito_elongation,
    round(avg(flatness_b_over_c),6) mean_mito_flatness FROM mg GROUP BY 1,2)
  SELECT volume_id, cell_id, round(cell_volume_um3,9) cell_volume_um3, n mito_count, round(v,9) mito_volume_um3, round(v/cell_volume_um3,6) mito_volume_fraction,
    ag.* EXCLUDE (volume_id,cell_id) FROM cells JOIN cagg USING (volume_id,cell_id) JOIN ag USING (volume_id,cell_id)""")
def _(t):
    out = C.normalised_summary(cut(lean_objects(t)), cells(t))
    nine = ["cell_volume_um3", "mito_volume_um3", "mean_mito_volume_um3", "median_mito_volume_um3", "std_mito_volume_um3"]
    six = ["mito_volume_fraction", "mean_mito_size_norm", "mean_mito_elongation", "mean_mito_flatness"]
    return rounded(rounded(out, *nine, digits=9), *six)


@query("jn_8_object_cell_merge", f"""{QC} SELECT c.volume_id, c.label_id, c.cell_id, round(volume_um3,9) mito_volume_um3,
  round(cell_volume_um3,9) cell_volume_um3, round(volume_um3/cell_volume_um3,6) fraction FROM clean c JOIN qcells USING (volume_id,cell_id)""")
def _(t):
    clean, good = qc(t)
    out = C.objects_in_cells(clean, good).select(
        "volume_id", "label_id", "cell_id", "mito_volume_um3", "cell_volume_um3", F.col("mito_volume_fraction_of_cell").alias("fraction"))
    return rounded(rounded(out, "mito_volume_um3", "cell_volume_um3", digits=9), "fraction")


@query("jn_9_cell_aggregate_left", f"""{LEAN}, {CELLAGG} SELECT volume_id, cell_id, coalesce(n,0) mito_count, round(coalesce(v,0),9) mito_volume_um3
  FROM cells LEFT JOIN cagg USING (volume_id,cell_id)""")
def _(t):
    out = C.cell_table(cells(t), lean_objects(t)).select("volume_id", "cell_id", "mito_count", "mito_volume_um3")
    return rounded(out, "mito_volume_um3", digits=9)


@query("jn_10_surviving_objects", f"{QC} SELECT volume_id, label_id FROM clean SEMI JOIN qcells USING (volume_id,cell_id)")
def _(t):
    clean, good = qc(t)
    return clean.join(good, C.CELL, "left_semi").select("volume_id", "label_id")


@query("win_6_group_transform", f"""{LEAN}, {CELLAGG} SELECT o.volume_id, label_id, cell_id, round(volume_um3/cell_volume_um3,6) mito_size_norm,
  round(v/cell_volume_um3,6) mito_volume_density FROM objects o JOIN cells USING (volume_id,cell_id) JOIN cagg USING (volume_id,cell_id)""")
def _(t):
    out = C.normalised_objects(cut(lean_objects(t)), cells(t)).select(
        "volume_id", "label_id", "cell_id", "mito_size_norm", "mito_volume_density")
    return rounded(out, "mito_size_norm", "mito_volume_density")


@query("jn_13_nearest_neighbour", f"{OBJ}, {NND} SELECT volume_id, label, round(nearest_neighbor_um,6) nearest_neighbor_um FROM box LEFT JOIN nnd USING (volume_id,label)")
def _(t):
    near = O.nearest_object(O.centroid(t.labels("gt"), VOXEL_UM), 4 * max(VOXEL_UM))
    return rounded(near, "nearest_neighbor_um")


@query("jn_12_z_interval", f"{OBJ} SELECT volume_id, label, z0, z1 FROM box WHERE z0<=2 AND z1>=1")
def _(t):
    return O.bounding_box(t.labels("gt")).where("z0 <= 2 and z1 >= 1").select("volume_id", "label", "z0", "z1")
