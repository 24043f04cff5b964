"""Exact nearest neighbours by grid buckets of growing size.

Level ``l`` uses cells of edge ``base * 2**l``.  A query is settled at the
first level where its best hit in the surrounding 27 cells is no farther than
the cell edge, since anything outside those cells is farther.  Only unsettled
queries go on, and an unsettled query has no target within half the current
cell edge, so the pairs tried per target stay bounded at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.session import cut


def _cells(df: DataFrame, coords, edge, reach: int) -> DataFrame:
    out = df
    for i, c in enumerate(coords):
        home = F.floor(F.col(c) / F.lit(float(edge)))
        out = out.withColumn(
            f"_c{i}", F.explode(F.sequence(home - reach, home + reach)) if reach else home)
    return out


def nearest(queries: DataFrame, targets: DataFrame, keys: list[str], qid: list[str], tid: str | None,
            qcoords: list[str], tcoords: list[str], base: float, exclude_self: bool = False,
            max_levels: int = 48) -> DataFrame:
    """``keys + qid + dist [+ nearest_id]``, NULL where a key has no target.

    Ties go to the smallest ``tid`` (among copies of the query's own position,
    to the smallest or else the largest other id).  With ``exclude_self`` a target whose id
    equals the query's first id column is skipped.
    """
    dims = range(len(qcoords))
    t = targets.select(*keys, *[F.col(c).cast("double").alias(f"_t{i}") for i, c in enumerate(tcoords)],
                       (F.col(tid) if tid else F.lit(0)).alias("_tid"))
    q = queries.select(*keys, *qid, *[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(qcoords)])
    # One target per position: copies of a position, however many, never meet pairwise.
    spots = cut(t.groupBy(*keys, *[f"_t{i}" for i in dims]).agg(
        F.min("_tid").alias("_tid"), F.max("_tid").alias("_top"), F.count(F.lit(1)).alias("_n")))
    have = spots.groupBy(*keys).agg(F.sum("_n").alias("_have"))
    here = spots.select(*keys, *[F.col(f"_t{i}").alias(f"_q{i}") for i in dims], "_tid", "_top", "_n")
    q = q.join(here, keys + [f"_q{i}" for i in dims], "left").join(have, keys, "left")
    if exclude_self:
        same = F.col("_n") >= 2
        other = F.when(F.col("_tid") != F.col(qid[0]), F.col("_tid")).otherwise(F.col("_top"))
    else:
        same, other = F.col("_n").isNotNull(), F.col("_tid")
    same = F.coalesce(same, F.lit(False))
    alone = F.coalesce("_have", F.lit(0)) < (2 if exclude_self else 1)
    q = cut(q.select(*keys, *qid, *[f"_q{i}" for i in dims], (same | alone).alias("_known"),
                     F.when(same, 0.0).alias("dist"), F.when(same, other).cast("long").alias("nearest_id")))
    done = q.where("_known").select(*keys, *qid, "dist", "nearest_id")
    todo = q.where("not _known").drop("_known", "dist", "nearest_id")
    if todo.isEmpty():
        return done
    t = spots.drop("_top", "_n")
    edge = float(base)
    for _ in range(max_levels):
        # The shrinking side, the open queries, is copied to the cells around it.
        asking = _cells(todo, [f"_q{i}" for i in dims], edge, 1)
        pairs = asking.join(_cells(t, [f"_t{i}" for i in dims], edge, 0), keys + [f"_c{i}" for i in dims])
        if exclude_self:
            pairs = pairs.where(F.col(qid[0]) != F.col("_tid"))
        d2 = sum(((F.col(f"_q{i}") - F.col(f"_t{i}")) * (F.col(f"_q{i}") - F.col(f"_t{i}")) for i in dims), F.lit(0.0))
        best = pairs.groupBy(*keys, *qid).agg(F.min(F.struct(F.sqrt(d2).alias("d"), F.col("_tid").alias("i"))).alias("_b"))
        state = cut(todo.join(best, keys + qid, "left"))
        settled = F.coalesce(F.col("_b.d") <= edge, F.lit(False))
        done = done.unionByName(state.where(settled).select(
            *keys, *qid, F.col("_b.d").alias("dist"), F.col("_b.i").cast("long").alias("nearest_id")))
        todo = state.where(~settled).drop("_b")
        if todo.isEmpty():
            return done
        edge *= 2
    raise ValueError("nearest: coordinates span more than the allowed levels")
