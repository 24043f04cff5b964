"""Shape measures as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_eigenvalues(df: DataFrame, a: str, d: str, f: str, b: str, c: str, e: str) -> DataFrame:
    """Add ``_l1 >= _l2 >= _l3``, the eigenvalues of the symmetric matrix
    [[a,b,c],[b,d,e],[c,e,f]], by the trigonometric closed form.

    Every step is its own column: one nested expression would repeat its
    operands until the generated code passes the JVM method limit.
    """
    a, d, f, b, c, e = (F.col(n) for n in (a, d, f, b, c, e))
    m, p = F.col("_m"), F.col("_p")
    u, v, w = F.col("_u"), F.col("_v"), F.col("_w")
    steps = [
        ("_m", (a + d + f) / 3),
        ("_u", a - m), ("_v", d - m), ("_w", f - m),
        ("_p", F.sqrt((u * u + v * v + w * w + 2 * (b * b + c * c + e * e)) / 6)),
        ("_r", (u * (v * w - e * e) - b * (b * w - e * c) + c * (b * e - v * c)) / F.nullif(2 * p * p * p, F.lit(0.0))),
        ("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_r")))) / 3),
        ("_l1", F.when(p == 0, m).otherwise(m + 2 * p * F.cos("_phi"))),
        ("_l3", F.when(p == 0, m).otherwise(m + 2 * p * F.cos(F.col("_phi") + 2 * math.pi / 3))),
        ("_l2", 3 * m - F.col("_l1") - F.col("_l3")),
    ]
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop("_m", "_u", "_v", "_w", "_p", "_r", "_phi")


def sphericity(volume: Column, surface: Column) -> Column:
    ok = (volume > 0) & (surface > 0)
    return F.when(ok, math.pi ** (1 / 3) * F.pow(6 * volume, F.lit(2 / 3)) / surface)


def ratio(num: Column, den: Column) -> Column:
    """NULL where the denominator is zero or missing."""
    return F.when(den != 0, num / den)


def log10_shifted(c: Column) -> Column:
    return F.log10(c + F.lit(1e-9))


def voxel_size_um(nm: Column) -> Column:
    """One number is isotropic, two are (z, xy), three are (z, y, x); nm to um."""
    z = F.element_at(nm, 1)
    y = F.when(F.size(nm) == 1, z).otherwise(F.element_at(nm, 2))
    x = F.when(F.size(nm) >= 3, F.get(nm, F.lit(2))).otherwise(y)
    return F.when(F.size(nm).isin(1, 2, 3), F.struct(
        (z * 1e-3).alias("z"), (y * 1e-3).alias("y"), (x * 1e-3).alias("x")))


def phenotype_by_shape(elong, flat, euler, branches) -> Column:
    """First matching rule wins."""
    # Classes and thresholds of the published rule.
    return (
        F.when((elong < 1.6) & (flat < 1.2) & (euler == 1), "Round")
        .when((elong >= 3.5) & (flat < 1.3) & (euler == 1), "Tubular")
        .when(euler == 0, "Donut")
        .when(branches > 0, "Branched")
        .otherwise("Other")
    )


def phenotype_by_volume(elong, flat, spher, euler, branches, volume, high_volume) -> Column:
    # Classes and thresholds of the published rule.
    return (
        F.when(euler == 0, "Donut")
        .when(branches > 0, "Branched")
        .when((volume >= high_volume) & (spher <= 0.5), "Swollen")
        .when((elong <= 1.6) & (spher >= 0.8), "Round")
        .when((elong >= 3.0) & (flat <= 1.2), "Tubular")
        .otherwise("Other")
    )
