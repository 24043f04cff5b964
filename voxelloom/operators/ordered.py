"""Order statistics that never put a whole group into one task.

A plain ``Window.partitionBy(key).orderBy(v)`` sorts a hot key in a single
task.  Here the rows are range-partitioned on ``keys + order`` instead, so a
hot key is spread over many tasks; each task computes its local prefix and a
small table of per-task totals supplies the offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.operators.joins import join_small
from voxelloom.session import cut, parallelism


def prefix_totals(df: DataFrame, keys: list[str], order: list, sums: list[str] = ()) -> DataFrame:
    """Add ``rn`` (1-based position in key), ``rows_total`` and, for every
    column ``c`` in ``sums``, ``cum_c`` (inclusive) and ``tot_c``.

    ``order`` holds column names or sort expressions over columns that are
    unique within a key.
    """
    parts = parallelism(df.sparkSession)
    order = [F.col(o).asc() if isinstance(o, str) else o for o in order]
    by = [F.col(k).asc() for k in keys] + order
    spread = cut(df.repartitionByRange(parts, *by).withColumn("_p", F.spark_partition_id()))

    totals = spread.groupBy(*keys, "_p").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)

    def both(col: str, name: str) -> list[Column]:
        return [
            F.coalesce(F.sum(col).over(before), F.lit(0)).alias(f"_o_{name}"),
            F.sum(col).over(whole).alias(f"_t_{name}"),
        ]

    offsets = totals.select(
        *keys, "_p", *both("_n", "rows"), *[e for c in sums for e in both(f"_s_{c}", c)]
    )
    local = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.select(
        "*",
        F.count(F.lit(1)).over(local).alias("_l_rows"),
        *[F.sum(c).over(local).alias(f"_l_{c}") for c in sums],
    )
    joined = ranked.join(offsets, keys + ["_p"])
    return joined.select(
        *df.columns,
        (F.col("_l_rows") + F.col("_o_rows")).alias("rn"),
        F.col("_t_rows").alias("rows_total"),
        *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"_t_{c}").alias(f"tot_{c}") for c in sums],
    )


def suffix_minimum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``out`` = minimum of ``value`` over this row and all later rows."""
    parts = parallelism(df.sparkSession)
    spread = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    # one row per partition of the range exchange, whatever the data size
    later = Window.orderBy("_p").rowsBetween(1, Window.unboundedFollowing)
    tail = (
        spread.groupBy("_p").agg(F.min(value).alias("_m"))
        .select("_p", F.min("_m").over(later).alias("_after"))
    )
    local = Window.partitionBy("_p").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return (
        spread.withColumn("_m", F.min(value).over(local))
        .join(tail, "_p")
        .withColumn(out, F.least("_m", "_after"))
        .drop("_p", "_m", "_after")
    )


def exact_quantiles(df: DataFrame, keys: list[str], col: str, probs: list[float],
                    names: list[str], weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key from a distributed value
    histogram; one row per key."""
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(counted.alias("_cnt"))
    run = prefix_totals(hist, keys, [col], ["_cnt"])
    picks, outs = [], []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("tot__cnt") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("cum__cnt") > F.floor(pos), F.col(col))).alias(f"_lo{i}"),
            F.min(F.when(F.col("cum__cnt") > F.ceil(pos), F.col(col))).alias(f"_hi{i}"),
            F.first(pos - F.floor(pos)).alias(f"_f{i}"),
        ]
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"))
                    .cast("double").alias(name))
    return run.groupBy(*keys).agg(*picks).select(*keys, *outs)


def medians(df: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
    """Exact medians of several columns in one distributed pass.

    ``cols`` maps a source column to its output name.
    """
    long = melt(df, keys, list(cols))
    med = exact_quantiles(long, keys + ["metric"], "value", [0.5], ["q"])
    return med.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == c, F.col("q"))).alias(name) for c, name in cols.items()]
    )


def melt(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """Long form ``ids, metric, value``; NULL values dropped."""
    return (
        df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot(ids, cols, "metric", "value")
        .where(F.col("value").isNotNull())
    )


def dense_index(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Dense 1..N numbering of the distinct values of ``col`` inside each key."""
    ranks = prefix_totals(df.select(*keys, col).distinct(), keys, [col])
    return join_small(df, ranks.select(*keys, col, F.col("rn").alias(out)), keys + [col])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
