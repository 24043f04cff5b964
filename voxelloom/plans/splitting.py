"""Split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.fixtures import FILES, GROUPS_SQL, VOX
from voxelloom.operators import splits as SP
from voxelloom.plans.mapping import SPECIMEN
from voxelloom.plans.measure import rounded
from voxelloom.plans.registry import query

SPLIT = f"""{SPECIMEN}, pin AS (SELECT * FROM spec WHERE contains(path,'_eb12') OR contains(path,'_TS_12')),
 pool AS (SELECT * FROM spec s WHERE path NOT IN (SELECT path FROM pin) AND NOT EXISTS (SELECT 1 FROM pin p WHERE p.source=s.source AND p.specimen=s.specimen)),
 sz AS (SELECT source, genotype, specimen, count(*) n FROM pool GROUP BY 1,2,3),
 od AS (SELECT *, row_number() OVER w rn, count(*) OVER (PARTITION BY source,genotype) k, sum(n) OVER w - n before, round_even(0.1*sum(n) OVER (PARTITION BY source,genotype),0) tgt
   FROM sz WINDOW w AS (PARTITION BY source,genotype ORDER BY n, specimen)),
 sd AS (SELECT *, CASE WHEN k>=2 AND before<greatest(1,tgt) AND rn<k THEN 'val' ELSE 'train' END split FROM od),
 splits AS (SELECT path, source, genotype, specimen, split FROM pool JOIN sd USING (source,genotype,specimen) UNION ALL SELECT path, source, genotype, specimen, 'test' FROM pin)"""


def split(t):
    pinned = t.files.where("contains(path,'_eb12') or contains(path,'_TS_12')")
    return SP.grouped_stratified(t.files, 0.1, pinned, hold_out_siblings=True)


@query("spl_1_grouped_stratified", f"{SPLIT} SELECT path, source, genotype, specimen, split FROM splits")
def _(t):
    return SP.assert_no_leak(split(t))


@query("spl_2_split_audit", f"""{SPLIT}, a AS (SELECT source, genotype, {", ".join(
    f"count(*) FILTER (split='{s}') {s}_files, count(DISTINCT specimen) FILTER (split='{s}') {s}_specimens" for s in ("train", "val", "test"))} FROM splits GROUP BY 1,2)
  SELECT *, val_files=0 no_val, train_files=0 AND val_files>0 no_train FROM a""")
def _(t):
    return SP.split_audit(split(t))


@query("spl_2_leaks", f"""{FILES}, p AS (SELECT row_number() OVER (ORDER BY path) rn, count(*) OVER () n, path FROM files), s AS (SELECT path, rn<=n-floor(n*0.2::DOUBLE) tr FROM p),
  sp AS (SELECT s.*, x.source, x.specimen FROM s JOIN ({SPECIMEN} SELECT path, source, specimen FROM spec) x USING (path))
  SELECT source, specimen, true train_val, false in_test FROM sp GROUP BY 1,2 HAVING count(DISTINCT tr)>1""")
def _(t):
    return SP.leaking_specimens(SP.with_specimen(SP.positional(t.files)))


_POS = """p AS (SELECT path, row_number() OVER (ORDER BY path) rn, count(*) OVER () n FROM files),
 s AS (SELECT path, rn AS position, CASE WHEN rn<=n-floor(n*0.15::DOUBLE)-floor(n*0.05::DOUBLE) THEN 'train' WHEN rn<=n-floor(n*0.05::DOUBLE) THEN 'val' ELSE 'test' END split FROM p)"""


@query("spl_3_positional", f"{FILES}, {_POS} SELECT path, position, split FROM s")
def _(t):
    return SP.positional(t.files, 0.8, 0.15, 0.05)


_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query("spl_3_shuffled", f"""{FILES}, p AS (SELECT path, row_number() OVER (ORDER BY {_HASH.format("path || '|42'")}, path) rn, count(*) OVER () n FROM files)
  SELECT path, rn AS position, CASE WHEN rn<=n-floor(n*0.15::DOUBLE)-floor(n*0.05::DOUBLE) THEN 'train' WHEN rn<=n-floor(n*0.05::DOUBLE) THEN 'val' ELSE 'test' END split FROM p""")
def _(t):
    return SP.positional(t.files, 0.8, 0.15, 0.05, seed=42)


@query("spl_4_positional_ensured", f"""{FILES}, {_POS}, f AS (SELECT min(path) p FROM s WHERE contains(path,'cooper') AND split='test'), g AS (SELECT min(path) p FROM s WHERE contains(path,'cooper') AND split='train')
  SELECT path, position, CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE split='val' AND contains(path,'cooper')) AND path=coalesce((SELECT p FROM f),(SELECT p FROM g)) THEN 'val' ELSE split END split FROM s""")
def _(t):
    return SP.positional_ensured(t.files, ["cooper", "wichmann"], 0.8, 0.15, 0.05)


PATCH = ["volume_id", "py", "px"]
_PATCHES = f"{VOX}, pv AS (SELECT volume_id, y//8 py, x//8 px, gt label FROM vox), pg AS (SELECT DISTINCT volume_id, py, px FROM pv)"


def patches(t):
    return t.vox.selectExpr("volume_id", "y div 8 py", "x div 8 px", "gt label")


@query("spl_5_group_criteria", f"""{_PATCHES}, l AS (SELECT volume_id, py, px, label, count(*) n FROM pv WHERE label>0 GROUP BY ALL HAVING count(*)>=100),
  c AS (SELECT volume_id, py, px, group_id, count(*) k FROM l JOIN {GROUPS_SQL} USING (label) GROUP BY ALL), h AS (SELECT volume_id, py, px, count(*) g FROM c WHERE k>=1 GROUP BY 1,2,3)
  SELECT volume_id, py, px, coalesce(g,0) groups_found, coalesce(g,0)>=2 at_least, coalesce(g,0)>=4 AS "every" FROM pg LEFT JOIN h USING (volume_id,py,px)""")
def _(t):
    found = SP.patch_groups(patches(t), t.label_groups, PATCH, min_size=100)
    return SP.accept_patches(patches(t).select(*PATCH).distinct(), found, PATCH, n_groups=4, min_groups=2)


def _draw(seed):
    return _HASH.format(f"volume_id || '|' || py || '|' || px || '|{seed}'") + " % 1000000"


@query("spl_5_weighted_accept", f"""{_PATCHES}, l AS (SELECT volume_id, py, px, label, count(*) n FROM pv WHERE label>0 GROUP BY ALL),
  c AS (SELECT volume_id, py, px, group_id, count(*) k FROM l JOIN {GROUPS_SQL} USING (label) GROUP BY ALL), h AS (SELECT volume_id, py, px, count(*) g FROM c WHERE k>=1 GROUP BY 1,2,3),
  d AS (SELECT *, {_draw(8)} u, {_draw(7)} < 750000 rare, {_draw(9)} < 50000 lucky FROM pg),
  e AS (SELECT *, CASE WHEN u<100000 THEN 1 WHEN u<300000 THEN 2 WHEN u<800000 THEN 3 ELSE 4 END group_id FROM d)
  SELECT volume_id, py, px, CASE WHEN rare THEN c.k IS NOT NULL ELSE coalesce(g,0)>=1 END OR lucky accepted FROM e LEFT JOIN c USING (volume_id,py,px,group_id) LEFT JOIN h USING (volume_id,py,px)""")
def _(t):
    found = SP.patch_groups(patches(t), t.label_groups, PATCH)
    return SP.weighted_accept(patches(t).select(*PATCH).distinct(), found, PATCH, {1: 1.0, 2: 2.0, 3: 5.0, 4: 2.0}, seed=7)


@query("spl_5_foreground_fraction", f"""{VOX}, s AS (SELECT volume_id, y//8 py, x//8 px, count(*) FILTER (state<2) n, count(*) FILTER (state<2 AND fg>0.75) k FROM vox GROUP BY 1,2,3)
  SELECT volume_id, py, px, round(k/nullif(n,0)::DOUBLE,6) fraction, coalesce(k/nullif(n,0)::DOUBLE>0.1,false) OR {_draw(3)} < 50000 accepted FROM s""")
def _(t):
    rows = t.vox.selectExpr("volume_id", "y div 8 py", "x div 8 px", "fg", "state")
    return rounded(SP.foreground_fraction(rows, PATCH, F.col("fg") > 0.75, F.col("state") < 2, 0.1, 0.95, seed=3), "fraction")


@query("spl_6_hash_sample", f"""{VOX} SELECT volume_id, z, y, x, fg, gt FROM vox WHERE {_HASH.format("volume_id || '|' || z || '|' || y || '|' || x || '|0'")} < 429496729""")
def _(t):
    return SP.hash_sample(t.vox.select("volume_id", "z", "y", "x", "fg", "gt"), ["volume_id", "z", "y", "x"], 0.1)


@query("spl_7_staged_split", f"{FILES} SELECT path, regexp_replace(path,'^.*/','') AS name FROM files WHERE NOT contains(path,'KO')")
def _(t):
    return SP.staged_split(t.files, ["KO"])


@query("win_7_prefix_before_row", f"""{SPECIMEN}, sz AS (SELECT source, genotype, specimen, count(*) n FROM spec GROUP BY 1,2,3)
  SELECT source, genotype, specimen, n, coalesce(sum(n) OVER (PARTITION BY source,genotype ORDER BY n, specimen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT files_before,
  row_number() OVER (PARTITION BY source,genotype ORDER BY n DESC, specimen DESC)=1 is_last FROM sz""")
def _(t):
    from voxelloom.operators.ordered import prefix_totals
    sizes = SP.with_specimen(t.files).groupBy("source", "genotype", "specimen").agg(F.count(F.lit(1)).alias("n"))
    run = prefix_totals(sizes, ["source", "genotype"], ["n", "specimen"], ["n"])
    return run.select("source", "genotype", "specimen", "n", (F.col("cum_n") - F.col("n")).alias("files_before"),
                      (F.col("rn") == F.col("rows_total")).alias("is_last"))
