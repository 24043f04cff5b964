"""Deterministic views that give the driver tables the shape of label volumes.

Every view is a narrow projection of one table, so all work built on it grows
with that table.  ``VOX`` and its siblings are the same views as SQL text for
the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.session import cut

VOXEL_UM = (0.025, 0.005, 0.005)

LABEL_GROUPS = [(1, 1), (1, 2), (1, 3), (2, 4), (2, 8), (2, 12), (2, 16), (3, 5), (4, 3), (4, 7)]

_VOX_STEPS = [
    ("vox_raw", """SELECT o_orderkey k, o_orderkey {div} 4096 volume_id, (o_orderkey%4096) {div} 1024 z,
      (o_orderkey%1024) {div} 32 y, o_orderkey%32 x,
      CAST(floor(o_totalprice) AS BIGINT)%256 raw, o_orderstatus st FROM orders"""),
    ("vox_box", """SELECT *,
      CASE WHEN y%8 BETWEEN 1 AND 6 AND x%8 BETWEEN 1 AND 6 THEN (y {div} 8)*4+(x {div} 8)+1 ELSE 0 END gt0,
      CASE WHEN y%8 BETWEEN 1 AND 6 AND (x+1)%8 BETWEEN 1 AND 6 AND x<31
           THEN (y {div} 8)*4+((x+1) {div} 8)+1 ELSE 0 END pr0 FROM vox_raw"""),
    ("vox", """SELECT volume_id, z, y, x, raw,
      CASE WHEN st='P' AND raw<64 THEN 0 ELSE gt0 END AS gt,
      CASE WHEN pr0%5=0 THEN 0 WHEN (volume_id+pr0)%7=0 AND y%8>3 THEN 0 ELSE pr0 END AS pred,
      CASE WHEN y%16=0 OR x%16=0 THEN 0 ELSE (y {div} 16)*2+(x {div} 16)+1 END AS cell,
      CAST(CASE WHEN gt0=0 THEN 0 WHEN gt0%4=0 THEN 2 ELSE 1 END AS BIGINT) AS state,
      round(least(1.0, CASE WHEN gt0>0 THEN 0.45 ELSE 0.05 END + (raw%50)/100.0),2) AS fg FROM vox_box"""),
]

_CTES = ",\n".join(f"{n} AS ({q})" for n, q in _VOX_STEPS)
VOX = ("WITH " + _CTES.format(div="//")
       + ",\nvol AS (SELECT volume_id, max(z)+1 nz, max(y)+1 ny, max(x)+1 nx FROM vox GROUP BY volume_id)")

_FILES = """SELECT c_custkey file_id, CASE c_custkey%4
  WHEN 0 THEN '/data/wichmann/WT'||c_nationkey||'_eb'||c_custkey||'_model_combined.h5'
  WHEN 1 THEN '/data/wichmann/KO'||c_nationkey||'_eb'||c_custkey||'_model_combined.h5'
  WHEN 2 THEN '/data/cooper/'||(36000+c_nationkey)||'_B'||(c_nationkey%4)||'_66K_TS_'||c_custkey||'_combined.h5'
  ELSE '/data/wichmann/Otof_AVCN'||lpad(CAST(c_nationkey AS {text}),2,'0')||'_455L_'||
       CASE WHEN c_nationkey%2=0 THEN 'WT' ELSE 'KO' END||'_'||c_custkey||'_combined.h5' END AS path
FROM customer"""
FILES = "WITH files AS (" + _FILES.format(text="VARCHAR") + ")"

_GRID = """SELECT p_partkey AS run_no,
  'mito_eval-run'||p_partkey||'_seg_sd'||(p_size%5+1)||'_bt0'||(p_partkey%4+1)||'_ft0'||(5+p_partkey%3) AS dataset,
  CAST(p_size%5+1 AS BIGINT) AS sd, p_partkey%4+1 AS bt, 5+p_partkey%3 AS ft,
  round((p_retailprice-900)/((SELECT max(p_retailprice) FROM part)-900),4) AS f1_score,
  round(1-abs(p_size-25)/25.0,4) AS sbd_score FROM part"""
GRID = "WITH grid AS (" + _GRID + ")"


class Tables:
    """The driver tables of one scale factor and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def vox(self) -> DataFrame:
        g = self.table("orders").selectExpr(
            "o_orderkey div 4096 volume_id", "(o_orderkey%4096) div 1024 z",
            "(o_orderkey%1024) div 32 y", "o_orderkey%32 x",
            "cast(floor(o_totalprice) as bigint)%256 raw", "o_orderstatus st")
        b = g.selectExpr(
            "*",
            "case when y%8 between 1 and 6 and x%8 between 1 and 6 then (y div 8)*4+(x div 8)+1 else 0L end gt0",
            "case when y%8 between 1 and 6 and (x+1)%8 between 1 and 6 and x<31 "
            "then (y div 8)*4+((x+1) div 8)+1 else 0L end pr0")
        return b.selectExpr(
            "volume_id", "z", "y", "x", "raw",
            "case when st='P' and raw<64 then 0L else gt0 end gt",
            "case when pr0%5=0 then 0L when (volume_id+pr0)%7=0 and y%8>3 then 0L else pr0 end pred",
            "case when y%16=0 or x%16=0 then 0L else (y div 16)*2+(x div 16)+1 end cell",
            "case when gt0=0 then 0L when gt0%4=0 then 2L else 1L end state",
            "round(least(1.0D, case when gt0>0 then 0.45D else 0.05D end + (raw%50)/100.0D),2) fg")

    @cached_property
    def volumes(self) -> DataFrame:
        """The volume catalog: one row per volume, computed once."""
        return cut(self.vox.groupBy("volume_id").agg(
            (F.max("z") + 1).alias("nz"), (F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx")))

    def labels(self, column: str = "gt", *extra: str) -> DataFrame:
        """Sparse label rows ``volume_id, z, y, x, label`` of one label column."""
        return self.vox.where(F.col(column) > 0).select(
            "volume_id", "z", "y", "x", F.col(column).alias("label"), *extra)

    @cached_property
    def files(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey file_id", """case c_custkey%4
          when 0 then '/data/wichmann/WT'||c_nationkey||'_eb'||c_custkey||'_model_combined.h5'
          when 1 then '/data/wichmann/KO'||c_nationkey||'_eb'||c_custkey||'_model_combined.h5'
          when 2 then '/data/cooper/'||(36000+c_nationkey)||'_B'||(c_nationkey%4)||'_66K_TS_'||c_custkey||'_combined.h5'
          else '/data/wichmann/Otof_AVCN'||lpad(cast(c_nationkey as string),2,'0')||'_455L_'||
            case when c_nationkey%2=0 then 'WT' else 'KO' end||'_'||c_custkey||'_combined.h5' end path""")

    @cached_property
    def grid(self) -> DataFrame:
        return self.spark.sql(
            """select p_partkey run_no,
              'mito_eval-run'||p_partkey||'_seg_sd'||(p_size%5+1)||'_bt0'||(p_partkey%4+1)||'_ft0'||(5+p_partkey%3) dataset,
              cast(p_size%5+1 as bigint) sd, p_partkey%4+1 bt, 5+p_partkey%3 ft,
              round((p_retailprice-900)/((select max(p_retailprice) from {part})-900),4) f1_score,
              round(1-abs(p_size-25)/25.0D,4) sbd_score from {part}""",
            part=self.table("part"))

    @cached_property
    def label_groups(self) -> DataFrame:
        return self.spark.createDataFrame(LABEL_GROUPS, "group_id long, label long")

    @cached_property
    def two_groups(self) -> DataFrame:
        """Measurement rows of two datasets (``A`` and ``R``)."""
        return self.table("lineitem").where("l_returnflag in ('A','R')").selectExpr(
            "l_returnflag dataset", "l_quantity", "l_extendedprice", "l_discount")


GROUPS_SQL = "(VALUES " + ",".join(f"({g},{lab})" for g, lab in LABEL_GROUPS) + ") t(group_id,label)"
