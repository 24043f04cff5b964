"""Resampling by per-axis index tables and shape bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import AXES
from voxelloom.operators.joins import join_small

SHAPE = [f"n{a}" for a in AXES]


def stride(vox: DataFrame, factors, origin=(0, 0, 0)) -> DataFrame:
    """Every f-th voxel per axis, counted from ``origin``."""
    out = vox
    for a, f, o in zip(AXES, factors, origin):
        shifted = F.col(a) - o
        out = out.where((shifted >= 0) & (F.pmod(shifted, F.lit(f)) == 0)).withColumn(a, F.floor(shifted / f))
    return out


def _index_table(volumes: DataFrame, axis: str, target: Column, source: Column) -> DataFrame:
    """``volume_id, _o, _s``: output index and source index along one axis;
    as many rows as the axis is long."""
    out = volumes.withColumn("_t", target)
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1)))
    return out.select("volume_id", F.col("_o"), source.cast("long").alias("_s"))


def _apply(vox: DataFrame, volumes: DataFrame, targets, rule) -> DataFrame:
    out = vox
    for a, t in zip(AXES, targets):
        table = _index_table(volumes, a, t, rule(F.col(f"n{a}"), F.col("_t"), F.col("_o")))
        out = join_small(out, table.withColumnRenamed("_s", a), ["volume_id", a], materialise=False).withColumn(a, F.col("_o")).drop("_o")
    return out.select(*vox.columns)


def _as_columns(shape) -> list[Column]:
    return [s if isinstance(s, Column) else F.lit(s).cast("long") for s in shape]


def pick_evenly(vox: DataFrame, volumes: DataFrame, shape) -> DataFrame:
    """Evenly spaced source indices, both ends included, fractions dropped."""
    def rule(n, t, o):
        return F.when(t == 1, F.lit(0)).otherwise(F.floor(o * (n - 1) / F.greatest(t - 1, F.lit(1))))
    return _apply(vox, volumes, _as_columns(shape), rule)


def nearest(vox: DataFrame, volumes: DataFrame, shape) -> DataFrame:
    """Labels at ``round(o * in / out)`` (half to even), clipped to the volume."""
    def rule(n, t, o):
        return F.least(F.greatest(F.bround(o * (n / t)), F.lit(0)), n - 1)
    return _apply(vox, volumes, _as_columns(shape), rule)


def box_mean(vox: DataFrame, factors, value: str) -> DataFrame:
    """Mean over boxes of an integer factor; ragged edge boxes average what is there."""
    keys = [F.floor(F.col(a) / f).alias(a) for a, f in zip(AXES, factors)]
    return vox.groupBy("volume_id", *keys).agg(F.avg(value).alias(value))


def _separable(vox: DataFrame, volumes: DataFrame, shape, value: str, weights) -> DataFrame:
    """Sums of weighted voxels, axis by axis.  ``weights(table, axis)`` turns
    ``volume_id, n*, _t, _o`` (output index) into ``volume_id, _o, <axis>, _w``."""
    out = vox.select("volume_id", *AXES, F.col(value).cast("double").alias("_v"))
    for a, t in zip(AXES, _as_columns(shape)):
        table = volumes.withColumn("_t", t)
        table = table.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1)))
        rest = [b for b in AXES if b != a]
        out = (join_small(out, weights(table, a), ["volume_id", a], materialise=False).groupBy("volume_id", "_o", *rest)
               .agg(F.sum(F.col("_v") * F.col("_w")).alias("_v")).withColumnRenamed("_o", a))
    return out.select("volume_id", *AXES, F.col("_v").alias(value))


def _linear_weights(table: DataFrame, a: str) -> DataFrame:
    n = F.col(f"n{a}")
    at = F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), (F.col("_o") + 0.5) * n / F.col("_t") - 0.5))
    low = F.floor(at)
    table = table.select("volume_id", n, "_t", "_o", F.explode(F.array(
        F.struct(low.alias("s"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("s"), (at - low).alias("w")))).alias("_e"))
    return table.select("volume_id", f"n{a}", "_t", "_o", F.col("_e.s").alias(a), F.col("_e.w").alias("_w")).where("_w > 0")


def _smooth_weights(table: DataFrame, a: str) -> DataFrame:
    """Linear weights of Gaussian means: both are linear, so one table holds both."""
    n, half = F.col(f"n{a}"), F.greatest(F.lit(0.0), (F.col(f"n{a}") / F.col("_t") - 1) / 2)  # half is the deviation
    reach = F.floor(half * 4 + 0.5)
    taps = F.sequence(-reach, reach)

    def bell(k):
        return F.exp(-(k * k) / F.greatest(2 * half * half, F.lit(1e-300)))

    total = F.aggregate(taps, F.lit(0.0), lambda s, k: s + bell(k))
    spread = _linear_weights(table, a).withColumn("_total", total).withColumn("_k", F.explode(taps))
    period = F.greatest(2 * (n - 1), F.lit(1))
    at = F.pmod(F.col(a) + F.col("_k"), period)
    spread = spread.select("volume_id", "_o", F.least(at, period - at).alias(a), (F.col("_w") * bell(F.col("_k")) / F.col("_total")).alias("_w"))
    return spread.groupBy("volume_id", "_o", a).agg(F.sum("_w").alias("_w"))


def linear(vox: DataFrame, volumes: DataFrame, shape, value: str) -> DataFrame:
    """Separable linear interpolation at pixel centres, edges held."""
    return _separable(vox, volumes, shape, value, lambda table, a: _linear_weights(table, a).drop(f"n{a}", "_t"))


def antialiased(vox: DataFrame, volumes: DataFrame, shape, value: str) -> DataFrame:
    """Linear interpolation of Gaussian means, for smaller shapes.

    Along an axis that shrinks by ``f`` the deviation is ``(f - 1) / 2``, cut off at
    four deviations, with the volume mirrored at its outer voxels (which are not
    repeated); an axis that does not shrink is interpolated only.  A voxel reaches
    a handful of output places whatever ``f`` is.  Voxels not stored are 0.
    """
    return _separable(vox, volumes, shape, value, _smooth_weights)


def rescale_plan(volumes: DataFrame, source_size, target_size, skip_ratio: float = 4.0) -> DataFrame:
    """Output shape for a target voxel size; volumes whose ratio reaches
    ``skip_ratio`` on an axis are flagged and left alone."""
    ratios = [s / t for s, t in zip(source_size, target_size)]
    shape = [F.bround(F.col(n) * F.lit(r)).cast("long").alias(f"out_{n}") for n, r in zip(SHAPE, ratios)]
    worst = max(max(r, 1 / r) for r in ratios)
    return volumes.select("volume_id", *SHAPE, *shape, *[F.lit(r).alias(f"ratio_{a}") for a, r in zip(AXES, ratios)],
                          F.lit(worst >= skip_ratio).alias("skipped"))


def common_shape(volumes: DataFrame, group: list[str]) -> DataFrame:
    """Largest extent per axis over the volumes of a group."""
    return volumes.groupBy(*group).agg(*[F.max(n).alias(f"max_{n}") for n in SHAPE])


def align_to_common(vox: DataFrame, volumes: DataFrame, group: Column) -> DataFrame:
    """Labels brought to their group's largest shape by nearest index."""
    tagged = volumes.withColumn("_g", group)
    full = tagged.join(common_shape(tagged, ["_g"]), "_g")
    return nearest(vox, full, [F.col(f"max_{n}") for n in SHAPE])


def pad_centred(vox: DataFrame, volumes: DataFrame, shape) -> DataFrame:
    """Shift voxels so that the volume sits in the middle of ``shape``; the
    larger half of an odd margin comes first."""
    out = join_small(vox, volumes, ["volume_id"], materialise=False)
    for a, want in zip(AXES, shape):
        before = F.ceil(F.greatest(F.lit(0), F.lit(want) - F.col(f"n{a}")) / 2)
        out = out.withColumn(a, F.col(a) + before)
    return out.select(*vox.columns)


def integer_scale(a: list[Column], b: list[Column]) -> Column:
    """max(1, round(mean axis ratio)) between two shapes."""
    mean = sum((x / y for x, y in zip(a[1:], b[1:])), a[0] / b[0]) / len(a)
    return F.greatest(F.lit(1), F.bround(mean)).cast("long")


def axis_scale(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(a / b)).cast("long")
