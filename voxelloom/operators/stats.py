"""Two-group tests, correlations and grid-search tables."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.pvalues import rank_p, student_p
from voxelloom.functions.shape import ratio
from voxelloom.operators.ordered import exact_quantiles, melt, prefix_totals, suffix_minimum, union_all

# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959964


def long_frame(a: DataFrame, b: DataFrame, metrics: list[str], names: tuple[str, str]) -> DataFrame:
    """Two datasets as ``dataset, metric, value``."""
    parts = [df.withColumn("dataset", F.lit(n)).select("dataset", *metrics) for df, n in ((a, names[0]), (b, names[1]))]
    return melt(parts[0].unionByName(parts[1]), ["dataset"], metrics)


def two_sample_summary(long: DataFrame, first: str, second: str) -> DataFrame:
    """n, mean, median, std of each side per metric and the ratio of means;
    metrics with fewer than two values on a side are left out."""
    base = long.groupBy("metric", "dataset").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    med = exact_quantiles(long, ["metric", "dataset"], "value", [0.5], ["median"])
    full = base.join(med, ["metric", "dataset"])
    side = {s: [F.max(F.when(F.col("dataset") == name, F.col(c))).alias(f"{c}_{s}") for c in ("n", "mean", "median", "std")]
            for s, name in (("a", first), ("b", second))}
    out = full.groupBy("metric").agg(*side["a"], *side["b"]).where("n_a >= 2 and n_b >= 2")
    return out.withColumn("ratio_mean", ratio(F.col("mean_b"), F.col("mean_a")))


def welch(summary: DataFrame) -> DataFrame:
    va = F.col("std_a") * F.col("std_a") / F.col("n_a")
    vb = F.col("std_b") * F.col("std_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb)
    df = (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    out = summary.withColumn("welch_t", F.when(va + vb > 0, t)).withColumn("welch_df", F.when(va + vb > 0, df))
    return out.withColumn("welch_p", student_p("welch_t", "welch_df"))


def mann_whitney(long: DataFrame, first: str, second: str) -> DataFrame:
    """U of the first sample with average ranks for ties, and its p: exact if a
    sample is small and nothing is tied, else tie-corrected normal.  Ranks come from a value histogram, so the work per task does not
    depend on how many rows one metric has."""
    hist = long.groupBy("metric", "value").agg(
        F.count(F.when(F.col("dataset") == first, 1)).alias("a"),
        F.count(F.when(F.col("dataset") == second, 1)).alias("b")).withColumn("m", F.col("a") + F.col("b"))
    run = prefix_totals(hist, ["metric"], ["value"], ["a", "b", "m"])
    mid = F.col("cum_m") - F.col("m") + (F.col("m") + 1) / 2
    m = F.col("m").cast("double")
    agg = run.groupBy("metric").agg(
        F.max("tot_a").alias("n_a"), F.max("tot_b").alias("n_b"),
        F.sum(F.col("a") * mid).alias("_r"), F.sum(m * m * m - m).alias("_ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("_r") - na * (na + 1) / 2
    var = na * nb / 12 * ((n + 1) - F.coalesce(F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0)), F.lit(0.0)))
    gap = F.abs(u - na * nb / 2) - 0.5
    z = F.when(var > 0, F.greatest(gap, F.lit(0.0)) / F.sqrt(var))
    out = agg.select("metric", "n_a", "n_b", u.alias("mw_u"), z.alias("mw_z"), F.coalesce("_ties", F.lit(0.0)).alias("_ties"))
    return out.withColumn("mw_p", rank_p("mw_u", "n_a", "n_b", "_ties", "mw_z")).drop("_ties")


def benjamini_hochberg(tests: DataFrame, p: str, unique: str, alpha: float = 0.05) -> DataFrame:
    """Step-up adjusted p-values; ``unique`` breaks ties of the order."""
    ranked = prefix_totals(tests.where(F.col(p).isNotNull()), [], [p, unique])
    ranked = ranked.withColumn("_q", F.col(p) * F.col("rows_total") / F.col("rn"))
    out = suffix_minimum(ranked, ["rn"], "_q", "p_fdr_bh")
    out = out.withColumn("p_fdr_bh", F.least(F.lit(1.0), F.col("p_fdr_bh"))).drop("_q", "rn", "rows_total")
    return out.withColumn("significant", F.col("p_fdr_bh") <= alpha)


def cohens_d() -> Column:
    """(b - a) over the n-weighted pooled standard deviation."""
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(((na - 1) * F.col("std_a") * F.col("std_a") + (nb - 1) * F.col("std_b") * F.col("std_b")) / (na + nb - 2))
    return F.when(pooled == 0, F.lit(0.0)).otherwise((F.col("mean_b") - F.col("mean_a")) / pooled)


def cohens_d_mean_variance() -> Column:
    """(a - b) over the root of the plain mean of both variances."""
    pooled = F.sqrt((F.col("std_a") * F.col("std_a") + F.col("std_b") * F.col("std_b")) / 2)
    return F.when(pooled == 0, F.lit(0.0)).otherwise((F.col("mean_a") - F.col("mean_b")) / pooled)


def rank_biserial(u: Column, n1: Column, n2: Column) -> Column:
    return 1 - ratio(2 * u, n1 * n2)


def full_comparison(long: DataFrame, first: str, second: str) -> DataFrame:
    """The whole test table, sorted by the rank-test p."""
    base = welch(two_sample_summary(long, first, second))
    mw = mann_whitney(long, first, second).select("metric", "mw_u", "mw_p")
    out = base.join(mw, "metric").withColumn("cohens_d", cohens_d()).withColumn(
        "rank_biserial", rank_biserial(F.col("mw_u"), F.col("n_a"), F.col("n_b")))
    return benjamini_hochberg(out, "mw_p", "metric").orderBy("mw_p", "metric")


def compare_datasets(long: DataFrame, first: str, second: str) -> DataFrame:
    """Mean, coefficient of variation and ratio of means per metric."""
    agg = []
    for s, name in (("a", first), ("b", second)):
        v = F.when(F.col("dataset") == name, F.col("value"))
        agg += [F.avg(v).alias(f"mean_{s}"), F.stddev_samp(v).alias(f"_s{s}")]
    out = long.groupBy("metric").agg(*agg).where("mean_a is not null and mean_b is not null")
    return out.select("metric", "mean_a", ratio(F.col("_sa"), F.col("mean_a")).alias("cv_a"), "mean_b",
                      ratio(F.col("_sb"), F.col("mean_b")).alias("cv_b"),
                      ratio(F.col("mean_b"), F.col("mean_a")).alias("ratio_mean"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise complete Pearson matrix as ``a, b, r`` from one aggregation."""
    pairs = list(combinations_with_replacement(sorted(columns), 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def by_parameter(df: DataFrame, parameters: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean, std and count of each metric for every value of every parameter."""
    long = df.select(*metrics, F.inline(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).cast("long").alias("parameter_value")) for p in parameters])))
    aggs = [e for m in metrics for e in (
        F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.stddev_samp(m), digits).alias(f"{m}_std"), F.count(m).alias(f"{m}_count"))]
    return long.where(F.col("parameter_value").isNotNull()).groupBy("parameter", "parameter_value").agg(*aggs)


def pivot_means(df: DataFrame, rows: str, columns: str, values: list, metric: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(metric))


def describe(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, in long form."""
    by = list(by)
    long = melt(df, by, columns)
    keys = by + ["metric"]
    base = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return base.join(exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"]), keys)


def anomalies(df: DataFrame, f1: str, sbd: str) -> DataFrame:
    def n(cond):
        return F.count(F.when(cond, 1))
    return df.agg(n(F.col(f1) == 1).alias("perfect_f1"), n(F.col(sbd) > 0.9999).alias("perfect_sbd"), n(F.col(f1) > 0.99).alias("near_perfect_f1"))


def parameter_values(df: DataFrame, parameters: list[str]) -> DataFrame:
    """Sorted distinct values per parameter, one row each."""
    return union_all([
        df.where(F.col(p).isNotNull()).select(F.lit(p).alias("parameter"), F.col(p).cast("long").alias("value")).distinct()
        for p in parameters]).orderBy("parameter", "value")


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p = k / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (centre - half) / scale, (centre + half) / scale


def class_proportions(df: DataFrame, cls: str) -> DataFrame:
    """Share of each class with its Wilson interval, largest first."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("n")).withColumn("_j", F.lit(1))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return counts.withColumn("_j", F.lit(1)).join(total, "_j").drop("_j").select(
        cls, "k", "n", (F.col("k") / F.col("n")).alias("proportion"), lo.alias("ci_low"), hi.alias("ci_high"),
    ).orderBy(F.col("proportion").desc(), cls)


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Empirical distribution at every distinct value."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = prefix_totals(hist, keys, [value], ["n"])
    return run.select(*keys, value, "n", (F.col("cum_n") / F.col("tot_n")).alias("ecdf"))


def box_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])


def parameter_grid(base: DataFrame, **values: list) -> DataFrame:
    """Every combination of the listed parameter values for each row of ``base``."""
    out = base
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return out


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values to NULL, NULL to the exact column median, z-scores;
    columns without spread go."""
    clean = df
    for c in columns:
        v = F.col(c).cast("double")
        clean = clean.withColumn(c, F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v))
    med = exact_quantiles(melt(clean, [], columns), ["metric"], "value", [0.5], ["q"])
    wide = med.agg(*[F.max(F.when(F.col("metric") == c, F.col("q"))).alias(f"_m_{c}") for c in columns])
    filled = clean.withColumn("_j", F.lit(1)).join(F.broadcast(wide.withColumn("_j", F.lit(1))), "_j").drop("_j")
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(c, f"_m_{c}"))
    spread = filled.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    used = [c for c in columns if spread[c]]
    stats = filled.agg(*[F.avg(c).alias(f"_a_{c}") for c in used], *[F.stddev_pop(c).alias(f"_s_{c}") for c in used])
    scored = filled.withColumn("_j", F.lit(1)).join(F.broadcast(stats.withColumn("_j", F.lit(1))), "_j")
    keep = [c for c in df.columns if c not in columns]
    return scored.select(*keep, *[((F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}")).alias(c) for c in used])


def cluster(df: DataFrame, columns: list[str], k_range=range(2, 5), seed: int = 42) -> DataFrame:
    """K-means on z-scored columns with k chosen by silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    from voxelloom.session import cut

    scored = standardised(df, columns)
    used = [c for c in columns if c in scored.columns]
    data = cut(VectorAssembler(inputCols=used, outputCol="features").transform(scored))
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    best = None
    for k in k_range:
        out = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data)
        score = judge.evaluate(out) if out.select("cluster").distinct().count() > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, k, out)
    return best[2].drop("features").withColumn("k", F.lit(best[1])).withColumn("silhouette", F.lit(best[0]))
