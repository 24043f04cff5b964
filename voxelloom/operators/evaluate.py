"""Scores of predicted against reference labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.assignment import best_matching
from voxelloom.operators.envelope import nearest_site
from voxelloom.operators.joins import join_small
from voxelloom.operators.labels import overlaps_of
from voxelloom.operators.objects import bounding_box, faces_touched
from voxelloom.operators.ordered import exact_quantiles, prefix_totals
from voxelloom.session import cut

EPS = 1e-8  # fixed value: part of the score formulas
# Sweep thresholds.
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [(tp / (tp + fp + EPS)).alias("precision"), (tp / (tp + fn + EPS)).alias("recall"),
            (2 * tp / (2 * tp + fp + fn + EPS)).alias("dice")]


def binary_scores(vox: DataFrame, gt: Column, pred: Column, keys: list[str], ignore: Column | None = None) -> DataFrame:
    """Voxel confusion and its ratios per key, ignored voxels left out."""
    rows = vox if ignore is None else vox.where(~ignore)
    counts = rows.groupBy(*keys).agg(
        _n(gt & pred).alias("tp"), _n(~gt & pred).alias("fp"), _n(gt & ~pred).alias("fn"),
        _n(pred).alias("pred_fg"), _n(gt).alias("gt_fg"), F.count(F.lit(1)).alias("eval_voxels"))
    return counts.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def instance_scores(vox: DataFrame, gt: str, pred: str, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Matching at an IoU threshold plus symmetric best Dice.

    Pairs above 0.5 are one-to-one by themselves.  Below it, as many pairs as
    possible are matched, with the largest total IoU (``best_matching``).
    """
    table = cut(vox.groupBy(*keys, gt, pred).agg(F.count(F.lit(1)).alias("n")))
    pairs = overlaps_of(table, gt, pred, keys)
    hits = pairs.where(F.col("iou") >= threshold)
    if threshold < 0.5:
        hits = best_matching(hits, gt, pred, keys)
    elif threshold == 0.5:
        # two pairs can share an object only when both sit exactly at one half
        hits = (hits.groupBy(*keys, gt).agg(F.min(F.struct((-F.col("iou")).alias("s"), F.col(pred).alias("p"))).alias("_b"))
                .select(*keys, gt, F.col("_b.p").alias(pred), F.col("_b.s").alias("s"))
                .groupBy(*keys, pred).agg(F.min(F.struct("s", gt)).alias("_b")))
    tp = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("tp"))
    counts = table.groupBy(*keys).agg(
        F.count_distinct(F.when(F.col(gt) > 0, F.col(gt))).alias("n_gt"),
        F.count_distinct(F.when(F.col(pred) > 0, F.col(pred))).alias("n_pred"))
    dice = 2 * F.col("n") / (F.col("n_a") + F.col("n_b"))

    def best(side: str, out: str) -> DataFrame:
        top = pairs.groupBy(*keys, side).agg(F.max(dice).alias("_d"))
        return top.groupBy(*keys).agg(F.sum("_d").alias(out))

    out = counts.join(tp, keys, "left").join(best(gt, "_bg"), keys, "left").join(best(pred, "_bp"), keys, "left")
    t, ng, np_ = F.coalesce("tp", F.lit(0)), F.col("n_gt"), F.col("n_pred")

    def share(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    return out.select(
        *keys, t.alias("tp"), "n_gt", "n_pred", share(t, np_).alias("precision"), share(t, ng).alias("recall"),
        share(2 * t, ng + np_).alias("f1_score"),
        F.least(share(F.coalesce("_bg", F.lit(0.0)), ng), share(F.coalesce("_bp", F.lit(0.0)), np_)).alias("sbd_score"),
        F.concat_ws(" / ", np_.cast("string"), ng.cast("string")).alias("pred_actual"))


def class_scores(vox: DataFrame, gt_class: str, pred_class: str, gt: str, pred: str, keys: list[str]) -> DataFrame:
    """Voxel and instance scores per semantic class."""
    classes = F.array_distinct(F.filter(F.array(gt_class, pred_class), lambda c: c > 0))
    merged = vox.select("*", F.explode(classes).alias("class_id")).select(
        *keys, "class_id",
        F.when(F.col(gt_class) == F.col("class_id"), F.col(gt)).otherwise(F.lit(0)).alias("g"),
        F.when(F.col(pred_class) == F.col("class_id"), F.col(pred)).otherwise(F.lit(0)).alias("p"))
    ck = keys + ["class_id"]
    binary = binary_scores(merged, F.col("g") > 0, F.col("p") > 0, ck).select(
        *ck, F.col("precision").alias("voxel_precision"), F.col("recall").alias("voxel_recall"), F.col("dice").alias("voxel_dice"))
    inst = instance_scores(merged, "g", "p", ck).select(*ck, "precision", "recall", "f1_score", "sbd_score")
    return inst.join(binary, ck)


def with_average(scores: DataFrame, name: str, metrics: list[str], counts: list[str], label: str) -> DataFrame:
    """Score rows plus one row of metric means and count sums."""
    rows = scores.select(name, *metrics, *counts)
    total = rows.agg(*[F.avg(m).alias(m) for m in metrics], *[F.sum(c).alias(c) for c in counts])
    return rows.unionByName(total.select(F.lit(label).alias(name), *metrics, *counts))


def ranking_scores(vox: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Average precision and ROC-AUC per key, ties handled by grouping equal
    scores first; exact on all voxels."""
    hist = vox.groupBy(*keys, score).agg(_n(positive).alias("pos"), F.count(F.lit(1)).alias("all"))
    run = prefix_totals(hist, keys, [F.col(score).desc()], ["pos", "all"])
    p = F.nullif(F.col("tot_pos"), F.lit(0))
    n = F.nullif(F.col("tot_all") - F.col("tot_pos"), F.lit(0))
    neg = F.col("all") - F.col("pos")
    above = F.col("cum_pos") - F.col("pos")
    agg = run.groupBy(*keys).agg(
        F.max("tot_pos").alias("n_pos"), F.max("tot_all").alias("n_all"),
        F.sum(F.col("pos") / p * F.col("cum_pos") / F.col("cum_all")).alias("_ap"),
        F.sum(neg * (above + F.col("pos") / 2) / (p * n)).alias("_auc"))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_all"))
    return agg.select(*keys, "n_pos", "n_all", F.when(both, F.col("_ap")).alias("ap"), F.when(both, F.col("_auc")).alias("auc"))


def threshold_sweep(vox: DataFrame, keys: list[str], score: str, positive: Column, thresholds=THRESHOLDS) -> DataFrame:
    """Confusion at each threshold (strict >).  Scores are counted by how many
    thresholds they pass, so a key shuffles one row more than there are thresholds."""
    order = sorted(float(t) for t in thresholds)
    passed = sum((F.coalesce(F.col(score) > t, F.lit(False)).cast("int") for t in order), F.lit(0))
    hist = vox.groupBy(*keys, passed.alias("_k")).agg(_n(positive).alias("pos"), F.count(F.lit(1)).alias("all"))
    wide = hist.select("*", F.posexplode(F.array(*[F.lit(t) for t in order])).alias("_i", "threshold"))
    hit = F.col("_k") > F.col("_i")
    counts = wide.groupBy(*keys, "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("all") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"))
    return counts.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def separation(vox: DataFrame, keys: list[str], score: str, gt: str, state: str) -> DataFrame:
    s, one, two = F.col(score), F.col(state) == 1, F.col(state) == 2
    pos = F.col(gt) > 0
    return vox.groupBy(*keys).agg(
        _n(one).alias("n_state1"), _n(one & pos).alias("gt_fg"), _n(two).alias("n_state2"),
        F.avg(F.when(one & pos, s)).alias("fg_mean_gtpos_state1"), F.avg(F.when(one & ~pos, s)).alias("fg_mean_gtneg_state1"),
        F.avg(F.when(two, (s > 0.5).cast("double"))).alias("frac_fg_gt0p5_state2"), F.avg(F.when(two, s)).alias("mean_fg_state2"))


def surface_voxels(mask: DataFrame, block=None) -> DataFrame:
    """Mask voxels with a missing 26-neighbour; outside the volume counts as missing."""
    import numpy as np

    from voxelloom.operators.blocks import gather, inner_origin, map_blocks
    from voxelloom.operators.labels import offsets
    from voxelloom.operators.morphology import shifted

    def kernel(arrays, origin, inner, meta):
        full = m = arrays["_on"]
        for off in offsets(26):
            full = full & shifted(m, off)
        return gather((m & ~full)[inner], inner_origin(origin, inner))

    args = (block,) if block else ()
    ones = mask.withColumn("_on", F.lit(True))
    return map_blocks(ones, kernel, "z long, y long, x long", {"_on": (np.bool_, False)}, *args, lo=(1, 1, 1), hi=(1, 1, 1), core_only=True)


def hausdorff95(gt: DataFrame, pred: DataFrame, volumes: DataFrame, spacing, block=None) -> DataFrame:
    """95th percentile of both directed surface distances per volume; 0 when
    both masks are empty, NULL when one is."""
    voxel = ["volume_id", "z", "y", "x"]
    a, b = (surface_voxels(df, block).select(*voxel) for df in (gt, pred))
    asking = cut(a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1))))
    given = asking.withColumn("_side", 1 - F.col("_side"))
    d = nearest_site(asking, given, spacing, ["volume_id", "_side"])
    q = exact_quantiles(d, ["volume_id"], "dist", [0.95], ["_q"])
    have = asking.select("volume_id", F.lit(True).alias("_any")).distinct()
    out = volumes.select("volume_id").join(have, "volume_id", "left").join(q, "volume_id", "left")
    return out.select("volume_id", F.when(F.col("_any").isNull(), F.lit(0.0)).otherwise(F.col("_q")).alias("hd95"))


def compare_models(scores: DataFrame, name: str, model: str, metrics: list[str]) -> DataFrame:
    """Mean per model over file rows; rows that are already averages are dropped."""
    rows = scores.where(~(F.col(name).ilike("%average%") | F.col(name).ilike("%all-files%")))
    return rows.groupBy(model).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])


def drop_border_objects(labels: DataFrame, volumes: DataFrame, max_faces: int, disregard_z: bool) -> DataFrame:
    """Objects that touch more than ``max_faces`` volume faces are removed."""
    if max_faces <= 0:
        return labels
    touched = faces_touched(bounding_box(labels), volumes, disregard_z).where(F.col("faces_touched") > max_faces)
    return join_small(labels, touched.select("volume_id", "label"), ["volume_id", "label"], "left_anti")


def metric_pivot(scores: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """One row per file and a column per model, with the row mean as difficulty."""
    wide = scores.groupBy(row).pivot(column, values).agg(F.avg(metric))
    total = sum((F.coalesce(F.col(v), F.lit(0.0)) for v in values), F.lit(0.0))
    known = sum((F.col(v).isNotNull().cast("int") for v in values), F.lit(0))
    return wide.withColumn("mean_score", F.when(known > 0, total / known))


def dice_reductions(patches: DataFrame, batch: str, patch: str, score: str, target: str) -> DataFrame:
    """Soft Dice loss per batch: pooled ratio of sums and mean of patch ratios."""
    p, t = F.col(score), F.col(target)
    sums = patches.groupBy(batch, patch).agg(F.sum(p * t).alias("i"), F.sum(p * p + t * t).alias("s"))
    floor = F.lit(1e-7)
    return sums.groupBy(batch).agg(
        (1 - 2 * F.sum("i") / F.greatest(F.sum("s"), floor)).alias("pooled_loss"),
        F.avg(1 - 2 * F.col("i") / F.greatest(F.col("s"), floor)).alias("per_sample_loss"))
