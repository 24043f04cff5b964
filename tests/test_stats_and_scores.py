import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions import pvalues as P
from voxelloom.operators import evaluate as E
from voxelloom.operators import ordered as OR
from voxelloom.operators import pairing as PA
from voxelloom.operators import splits as SP
from voxelloom.operators import stats as S


@pytest.fixture(scope="module")
def hot(spark):
    """One key owns most rows."""
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in rng.normal(size=4000).round(2)] + [(f"k{i % 50}", float(i % 7)) for i in range(500)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_quantiles_with_a_hot_key(hot):
    rows, df = hot
    got = {r.k: (r.a, r.b, r.c) for r in OR.exact_quantiles(df, ["k"], "v", [0.05, 0.5, 0.95], ["a", "b", "c"]).collect()}
    for k in {"hot", "k0", "k49"}:
        want = np.percentile([v for kk, v in rows if kk == k], [5, 50, 95])
        assert got[k] == pytest.approx(tuple(want))


def test_prefix_totals_with_a_hot_key(hot):
    rows, df = hot
    hist = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    out = OR.prefix_totals(hist, ["k"], ["v"], ["n"]).where("k = 'hot'").collect()
    vals = np.array([v for k, v in rows if k == "hot"])
    assert len(out) == len(set(vals))
    for r in out[::50]:
        assert r.cum_n == (vals <= r.v).sum() and r.tot_n == 4000 and r.rn == (np.unique(vals) <= r.v).sum()


def test_p_values():
    assert P.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert P.student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert P.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert P.regularised_beta(2, 3, 0.4) == pytest.approx(0.5248)


def long(spark, a, b):
    rows = [("m", "A", float(v)) for v in a] + [("m", "B", float(v)) for v in b]
    return spark.createDataFrame(rows, "metric string, dataset string, value double")


def test_rank_test_against_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 30), rng.integers(1, 8, 25)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    one = S.mann_whitney(long(spark, a, b), "A", "B").first()
    two = S.mann_whitney(long(spark, a, b), "B", "A").first()
    assert one.mw_u == u and one.mw_u + two.mw_u == 30 * 25 and one.mw_p == pytest.approx(two.mw_p)


def test_all_equal_ranks_have_no_z(spark):
    r = S.mann_whitney(long(spark, [1, 1], [1, 1, 1]), "A", "B").first()
    assert r.mw_u == 3 and r.mw_z is None


def test_small_groups_are_skipped(spark):
    assert S.two_sample_summary(long(spark, [1.0], [1.0, 2.0]), "A", "B").count() == 0


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "i long, p double")
    got = {r.i: r.p_fdr_bh for r in S.benjamini_hochberg(df, "p", "i").collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.9])


def test_full_comparison(spark):
    r = S.full_comparison(long(spark, [1, 2, 3, 4], [2, 4, 6, 8]), "A", "B").first()
    assert r.cohens_d == pytest.approx(2.5 / math.sqrt((5 / 3 + 20 / 3) / 2)) and 0 < r.welch_p < 1 and r.significant in (True, False)


def votes(spark, rows):
    return spark.createDataFrame(rows, "volume_id long, fg double, gt boolean")


def test_auc_of_equal_scores(spark):
    r = E.ranking_scores(votes(spark, [(0, 0.5, i % 3 == 0) for i in range(30)]), ["volume_id"], "fg", F.col("gt")).first()
    assert r.auc == pytest.approx(0.5) and r.ap == pytest.approx(1 / 3)


def test_one_class_has_no_rank_score(spark):
    r = E.ranking_scores(votes(spark, [(0, 0.5, True), (0, 0.7, True)]), ["volume_id"], "fg", F.col("gt")).first()
    assert r.ap is None and r.auc is None


def test_matching_below_one_half_is_one_to_one(spark):
    # predicted object 1 overlaps both references, 2 only the second
    rows = [(0, 0, 0, i, g, p) for i, (g, p) in enumerate([(1, 1)] * 5 + [(2, 1)] * 4 + [(2, 2)] * 3)]
    vox = spark.createDataFrame(rows, "volume_id long, z long, y long, x long, gt long, pred long")
    r = E.instance_scores(vox, "gt", "pred", ["volume_id"], 0.3).first()
    assert (r.tp, r.n_gt, r.n_pred) == (2, 2, 2)


def test_hausdorff_empty_cases(spark, frame, shapes):
    a = np.zeros((3, 3, 3), np.int64)
    a[1, 1, 1] = 1
    empty = np.zeros((3, 3, 3), np.int64)
    vol = shapes(a, empty, a)
    got = {r.volume_id: r.hd95 for r in E.hausdorff95(frame(a, empty, a), frame(a, empty, empty), vol, (1.0, 1.0, 1.0)).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: None}


def test_contains_match_takes_the_first(spark):
    raw = spark.createDataFrame([("a_1",), ("zz",), ("b",)], "stem string")
    lab = spark.createDataFrame([("xa_1y", 2, "second"), ("a_1", 1, "first"), ("bbb", 3, "b")], "text string, pos long, path string")
    got = {r.stem: r.path for r in PA.contains_match(raw, lab, "stem", "text", "pos", "path").collect()}
    assert got == {"a_1": "first", "zz": None, "b": "b"}


def test_contains_match_of_all_lengths(spark):
    """Against brute force; needles of 1 to 9 characters, some empty, null or repeated."""
    texts = ["abcabcabd", "bca", "", "aabbaabba", "cab", "dddddddddd", "abcdabcd"]
    needles = sorted({t[i : i + n] for t in texts for n in range(1, 10) for i in range(len(t))} | {"", "x", "abx", "ddddddddddd"}) + ["bca", None]
    raw = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "i int, n string")
    lab = spark.createDataFrame([(t, -i, f"p{i}") for i, t in enumerate(texts)] + [(None, -99, "null")], "text string, pos int, path string")
    want = {i: (max((k for k, t in enumerate(texts) if n in t), default=None) if n else None) for i, n in enumerate(needles)}
    for limit in (PA.MAX_HEADS, -1):  # heads sent to the tasks, and joined by shuffle
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(PA, "MAX_HEADS", limit)
            got = {r.i: r.path for r in PA.contains_match(raw, lab, "n", "text", "pos", "path").collect()}
        assert got == {i: None if k is None else f"p{k}" for i, k in want.items()}


def test_contains_match_broadcasts_no_exploded_table(spark):
    raw = spark.range(50).select(F.concat(F.lit("a_"), "id").alias("stem"))
    out = PA.contains_match(raw, raw.select("stem", F.col("stem").alias("text"), F.col("stem").alias("pos")), "stem", "text", "pos", "pos")
    plan = out._jdf.queryExecution().toString()
    assert "SortMergeJoin [stem" in plan and "BroadcastHashJoin [stem" not in plan


def test_pairing_fails_on_unequal_lists(spark):
    a = spark.createDataFrame([("a",), ("b",)], "p string")
    with pytest.raises(Exception, match="lists differ"):
        PA.pair_by_position(a, a.limit(1).withColumnRenamed("p", "q"), "p", "q").collect()


def files(spark, sizes):
    paths = [(f"/d/WT{i}_f{j}.h5",) for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(paths, "path string")


def test_split_rounding_and_last_specimen(spark):
    # 25 files: 0.1 * 25 = 2.5 rounds to 2, which the two smallest specimens cover
    out = SP.grouped_stratified(files(spark, [1, 1, 8, 15]), 0.1)
    assert {r.specimen for r in out.where("split = 'val'").collect()} == {"WT0", "WT1"}
    lone = SP.grouped_stratified(files(spark, [5]), 0.5)
    assert lone.where("split = 'val'").count() == 0
    assert SP.leaking_specimens(out).count() == 0


def test_leak_fails(spark):
    out = SP.grouped_stratified(files(spark, [2, 3]), 0.4, pinned=files(spark, [1]))
    with pytest.raises(Exception, match="both sides"):
        SP.assert_no_leak(out).collect()


def test_ensured_split_moves_one_file(spark):
    paths = [(f"/a/{i:02d}_{'rare' if i == 1 else 'x'}.h5",) for i in range(10)]
    out = {r.path: r.split for r in SP.positional_ensured(spark.createDataFrame(paths, "path string"), ["rare"]).collect()}
    assert out["/a/01_rare.h5"] == "val" and sum(s == "val" for s in out.values()) == 3
    with pytest.raises(ValueError):
        SP.positional_ensured(spark.createDataFrame(paths, "path string"), ["absent"])


def test_sampler_probability(spark):
    df = spark.range(4000).withColumnRenamed("id", "patch")
    n = df.where(SP.accept_by_hash(["patch"], 1, 0.25)).count()
    assert 850 < n < 1150 and n == df.where(SP.accept_by_hash(["patch"], 1, 0.25)).count()


def test_staged_split_rejects_repeats(spark):
    df = spark.createDataFrame([("/a/x.h5",), ("/b/x.h5",)], "path string")
    with pytest.raises(Exception, match="repeated base name"):
        SP.staged_split(df, []).collect()


def test_cluster_finds_two_groups(spark):
    rows = [(i, float(i % 2) * 10 + i * 0.001, float(i % 2) * 5, 1.0) for i in range(60)] + [(60, None, 5.0, 1.0)]
    out = S.cluster(spark.createDataFrame(rows, "i long, a double, b double, c double"), ["a", "b", "c"], range(2, 4))
    assert out.first().k == 2 and "c" not in out.columns and out.count() == 61


def test_pinned_files_need_not_be_listed(spark):
    paths = [(f"/data/wichmann/WT1_eb{i}_model_combined.h5",) for i in range(3)] + [(f"/data/wichmann/WT2_eb{i}_model_combined.h5",) for i in range(2)]
    pin = "/data/wichmann/WT1_eb9_model_combined.h5"
    out = SP.grouped_stratified(spark.createDataFrame(paths, "path string"), 0.1, spark.createDataFrame([(pin,), (pin,)], "path string"), hold_out_siblings=True)
    assert [r.path for r in out.where("split = 'test'").collect()] == [pin]
    assert {r.specimen for r in out.where("split <> 'test'").collect()} == {"WT2"}


def test_foreground_sampler_threshold_mask_and_draw(spark):
    rows = [(0, 0.9, 1)] * 1 + [(0, 0.1, 1)] * 9 + [(1, 0.9, 1)] * 2 + [(1, 0.1, 1)] * 8 + [(2, 0.9, 0)] * 5
    df = spark.createDataFrame(rows, "patch long, p double, ok int")
    args = (["patch"], F.col("p") > 0.75, F.col("ok") == 1, 0.1)
    got = {r.patch: (r.fraction, r.accepted) for r in SP.foreground_fraction(df, *args, p_reject=1.0).collect()}
    assert got == {0: (0.1, False), 1: (0.2, True), 2: (None, False)}  # a share equal to the least one is not enough
    assert all(r.accepted for r in SP.foreground_fraction(df, *args, p_reject=0.0).collect())


def test_hash_sample_has_no_cap(spark):
    df = spark.range(20_000).withColumn("key", F.lit(1))
    n = SP.hash_sample(df, ["id"], 0.3).count()
    assert abs(n - 6000) < 300 and SP.hash_sample(df, ["id"], 1.0).count() == 20_000


def test_p_values_of_huge_samples():
    """The t law tends to the normal one; the difference is below 1e-9 at these sizes."""
    for df in (1e9, 1e11, 1e13):
        assert P.student_two_sided(2.0, df) == pytest.approx(P.normal_two_sided(2.0), rel=1e-8)
    for t in (0.5, 2.0, 6.0):
        assert P.student_two_sided(t, 99_999) == pytest.approx(P.student_two_sided(t, 100_001), rel=1e-4)
        assert P.student_two_sided(t, 100_001) == pytest.approx(P.regularised_beta(100_001 / 2, 0.5, 100_001 / (100_001 + t * t), t * t / (100_001 + t * t)), rel=1e-7)


def test_exact_rank_law(spark):
    from itertools import combinations

    for small, large in ((1, 1), (2, 3), (3, 5), (4, 4)):
        us = [sum(r for r in c) - small * (small - 1) // 2 for c in combinations(range(small + large), small)]
        want = np.bincount(us, minlength=small * large + 1) / len(us)
        assert P.rank_counts(small, large) == pytest.approx(want)
    got = S.mann_whitney(long(spark, [1, 2, 3], [4, 5, 6, 7]), "A", "B").first()
    assert got.mw_p == pytest.approx(2 / 35)
    tied = S.mann_whitney(long(spark, [1, 2, 4], [4, 5, 6, 7]), "A", "B").first()
    assert tied.mw_p == pytest.approx(P.normal_two_sided(tied.mw_z))


def test_exact_rank_law_has_no_upper_size(spark):
    """Samples fully apart: two of all orders; and the tails against the table."""
    for small, large in ((1, 5), (3, 40), (8, 2000), (8, 3000)):
        shares = np.cumsum(P.rank_counts(small, large))
        for u in {k for k in (0, 1, 5, large, small * large // 3, small * large // 2) if 2 * k <= small * large}:
            assert P.rank_two_sided(u, large, small) == pytest.approx(min(1, 2 * shares[u]), rel=1e-6)
    rows = spark.createDataFrame([(0.0, 8, n, 0.0, -4.9) for n in (2000, 5000, 10**8)], "u double, a long, b long, ties double, z double")
    for r in rows.select("b", P.rank_p("u", "a", "b", "ties", "z").alias("p")).collect():
        assert r.p == pytest.approx(2 / math.comb(8 + r.b, 8), rel=1e-12)
