"""Leakage-safe splits and patch sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.naming import basename, contains_any, specimen
from voxelloom.operators.ordered import prefix_totals
from voxelloom.session import cut

UNIT = ["source", "specimen"]
STRATUM = ["source", "genotype"]


def with_specimen(files: DataFrame) -> DataFrame:
    return files.select("*", F.inline(F.array(specimen(F.col("path")))))


def grouped_stratified(files: DataFrame, val_ratio: float = 0.1, pinned: DataFrame | None = None,
                       hold_out_siblings: bool = False) -> DataFrame:
    """``path, source, genotype, specimen, split`` with whole specimens per side.

    ``pinned`` paths are test files whether or not ``files`` lists them, and
    with ``hold_out_siblings`` no other file of their specimens is used.

    In every stratum of two or more specimens the smallest specimens go to
    validation until the target number of files is covered; the largest always
    stays in training.  Picks are a prefix of that order, so "files before this
    specimen < target" decides each row without a loop.
    """
    every = with_specimen(files.select("path"))
    pool = every
    if pinned is not None:
        pins = with_specimen(pinned.select("path").distinct())
        pool = pool.join(pinned.select("path"), "path", "left_anti")
        if hold_out_siblings:
            pool = pool.join(pins.select(*UNIT).distinct(), UNIT, "left_anti")
    sizes = pool.groupBy(*STRATUM, "specimen").agg(F.count(F.lit(1)).alias("n_files"))
    order = prefix_totals(sizes, STRATUM, ["n_files", "specimen"], ["n_files"])
    target = F.greatest(F.lit(1), F.bround(F.col("tot_n_files") * F.lit(val_ratio)))
    chosen = (F.col("rows_total") >= 2) & (F.col("cum_n_files") - F.col("n_files") < target) & (F.col("rn") < F.col("rows_total"))
    side = order.select(*STRATUM, "specimen", F.when(chosen, "val").otherwise("train").alias("split"))
    out = pool.join(side, STRATUM + ["specimen"]).select("path", *STRATUM, "specimen", "split")
    if pinned is not None:
        out = out.unionByName(pins.select("path", *STRATUM, "specimen", F.lit("test").alias("split")))
    return out


def split_audit(split: DataFrame) -> DataFrame:
    """Files and specimens per stratum and side, with coverage flags."""
    aggs = []
    for s in ("train", "val", "test"):
        here = F.col("split") == s
        aggs += [F.count(F.when(here, 1)).alias(f"{s}_files"),
                 F.count_distinct(F.when(here, F.col("specimen"))).alias(f"{s}_specimens")]
    out = split.groupBy(*STRATUM).agg(*aggs)
    return out.withColumn("no_val", F.col("val_files") == 0).withColumn(
        "no_train", (F.col("train_files") == 0) & (F.col("val_files") > 0))


def leaking_specimens(split: DataFrame) -> DataFrame:
    """Specimens found on more than one side."""
    sides = split.groupBy(*UNIT).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    n = F.col("train") + F.col("val") + F.col("test")
    return sides.where(n > 1).select(*UNIT, ((F.col("train") + F.col("val")) > 1).alias("train_val"), (F.col("test") == 1).alias("in_test"))


def assert_no_leak(split: DataFrame, strict_test: bool = True) -> DataFrame:
    """The split itself; the job fails if a specimen leaks."""
    split = cut(split)
    bad = leaking_specimens(split)
    if not strict_test:
        bad = bad.where("train_val")
    count = bad.agg(F.count(F.lit(1)).alias("_bad")).withColumn("_j", F.lit(1))
    check = F.assert_true(F.col("_bad") == 0, F.lit("specimen on both sides of the split"))
    return split.withColumn("_j", F.lit(1)).join(F.broadcast(count), "_j").where(check.isNull()).select(*split.columns)


def positional(files: DataFrame, train: float = 0.8, val: float = 0.2, test: float = 0.0, seed: int | None = None) -> DataFrame:
    """Cut an ordered list by ratios; the rounding remainder goes to training.

    With a seed the order is a seeded hash of the path instead of the path.
    """
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("ratios must sum to one")
    rows = files.select("path")
    order: list = ["path"]
    if seed is not None:
        rows = rows.withColumn("_h", hash_number(["path"], seed))
        order = ["_h", "path"]
    run = prefix_totals(rows, [], order)
    n = F.col("rows_total")
    n_val, n_test = F.floor(n * F.lit(val)), F.floor(n * F.lit(test))
    n_train = n - n_val - n_test
    side = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test")
    return run.select("path", F.col("rn").alias("position"), side.alias("split"))


def positional_ensured(files: DataFrame, required: list[str], train: float = 0.8, val: float = 0.2, test: float = 0.0) -> DataFrame:
    """Positional split whose validation side holds a file for every required text.

    For each text missing from validation the first matching file moves over,
    from test if there is one, else from training.  A file that serves several
    texts moves once and the next match serves the later text.
    """
    split = cut(positional(files, train, val, test))
    present = split.where("split = 'val'").agg(*[
        F.count(F.when(F.col("path").contains(text), 1)).alias(f"_{i}") for i, text in enumerate(required)]).first()
    missing = [text for i, text in enumerate(required) if not present[i]]
    taken: list[str] = []

    def pick(text: str, side: str) -> str | None:
        rows = split.where(F.col("path").contains(text) & (F.col("split") == side) & ~F.col("path").isin(taken))
        return rows.agg(F.min_by("path", "position")).first()[0]

    for side in ("test", "train"):
        for text in missing:
            if len(taken) >= len(missing):
                break
            path = pick(text, side)
            if path is not None:
                taken.append(path)
    if len(taken) < len(missing):
        raise ValueError(f"no file outside validation contains one of {missing}")
    return split.withColumn("split", F.when(F.col("path").isin(taken), "val").otherwise(F.col("split")))


def dedupe_ordered(rows: DataFrame, key: str, position: str) -> DataFrame:
    """First row per key by position, as one partial aggregation."""
    rest = F.struct(position, *[c for c in rows.columns if c not in (key, position)])
    return rows.groupBy(key).agg(F.min_by(rest, position).alias("_r")).select(key, "_r.*")


def hash_number(cols: list[str], seed: int) -> Column:
    """32-bit number from the start of an MD5 digest, which any engine can repeat."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def accept_by_hash(cols: list[str], seed: int, probability: float) -> Column:
    """Deterministic stand-in for a random draw."""
    return F.pmod(hash_number(cols, seed), F.lit(1_000_000)) < F.lit(int(probability * 1_000_000))


def patch_groups(patches: DataFrame, groups: DataFrame, patch: list[str], min_size: int | None = None) -> DataFrame:
    """Instances of every label group in each patch: ``patch, group_id, n_instances``.

    ``patches`` holds ``patch`` keys and a ``label`` per labelled voxel.
    """
    sizes = patches.where(F.col("label") > 0).groupBy(*patch, "label").agg(F.count(F.lit(1)).alias("n"))
    if min_size is not None:
        sizes = sizes.where(F.col("n") >= min_size)
    return sizes.join(groups, "label").groupBy(*patch, "group_id").agg(F.count(F.lit(1)).alias("n_instances"))


def accept_patches(grid: DataFrame, found: DataFrame, patch: list[str], n_groups: int, min_groups: int = 1,
                   min_instances: int = 1) -> DataFrame:
    """``at_least`` (enough groups present) and ``every`` (all groups present)."""
    have = found.where(F.col("n_instances") >= min_instances).groupBy(*patch).agg(F.count(F.lit(1)).alias("_g"))
    g = F.coalesce("_g", F.lit(0))
    return grid.join(have, patch, "left").select(*patch, g.alias("groups_found"), (g >= min_groups).alias("at_least"), (g >= n_groups).alias("every"))


def weighted_accept(grid: DataFrame, found: DataFrame, patch: list[str], weights: dict[int, float], seed: int,
                    p_prioritised: float = 0.75, min_groups: int = 1, min_instances: int = 1, p_fallback: float = 0.05) -> DataFrame:
    """One hashed draw per patch: a weighted rare group decides, or else the
    number of groups present; rejected patches pass with ``p_fallback``."""
    total = sum(weights.values())
    draw = F.pmod(hash_number(patch, seed + 1), F.lit(1_000_000)) / 1_000_000.0
    pick, edge = F.lit(None).cast("long"), 0.0
    for g, w in weights.items():
        upto = edge + w / total
        pick = F.when((draw >= edge) & (draw < upto), F.lit(g).cast("long")).otherwise(pick)
        edge = upto
    good = found.where(F.col("n_instances") >= min_instances)
    count = good.groupBy(*patch).agg(F.count(F.lit(1)).alias("_g"))
    chosen = grid.select(*patch, pick.alias("group_id"), accept_by_hash(patch, seed, p_prioritised).alias("_rare"))
    chosen = chosen.join(good.select(*patch, "group_id", F.lit(True).alias("_hit")), patch + ["group_id"], "left").join(count, patch, "left")
    ok = F.when(F.col("_rare"), F.coalesce("_hit", F.lit(False))).otherwise(F.coalesce("_g", F.lit(0)) >= min_groups)
    return chosen.select(*patch, (ok | accept_by_hash(patch, seed + 2, p_fallback)).alias("accepted"))


def foreground_fraction(patches: DataFrame, patch: list[str], foreground: Column, counted: Column | None = None,
                        min_fraction: float = 0.1, p_reject: float = 0.95, seed: int = 0) -> DataFrame:
    """``fraction, accepted`` per patch: the share of its ``counted`` voxels
    that are ``foreground``.

    A patch is accepted when the share exceeds ``min_fraction``, any other one
    by a hashed draw with probability ``1 - p_reject``; without counted voxels
    the share is NULL and the draw decides.
    """
    counted = F.lit(True) if counted is None else counted
    share = F.count(F.when(counted & foreground, 1)) / F.nullif(F.count(F.when(counted, 1)), F.lit(0))
    out = patches.groupBy(*patch).agg(share.alias("fraction"))
    return out.withColumn("accepted", F.coalesce(F.col("fraction") > min_fraction, F.lit(False)) | accept_by_hash(patch, seed, 1 - p_reject))


def hash_sample(rows: DataFrame, identity: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash of their identity (the
    sampling operator itself); there is no cap, so no key is cut short."""
    return rows.where(hash_number(identity, seed) < F.lit(int(fraction * 2**32)))


def staged_split(files: DataFrame, exclude: list[str]) -> DataFrame:
    """Files without the excluded texts; fails on a repeated base name."""
    kept = files.where(~contains_any(F.col("path"), exclude)).withColumn("name", basename(F.col("path")))
    twice = kept.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    check = F.assert_true(F.col("_n") == 1, F.concat(F.lit("repeated base name "), F.col("name")))
    return kept.join(twice, "name").where(check.isNull()).select("path", "name")
