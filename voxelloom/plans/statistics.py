"""Statistics, grid-search, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.fixtures import FILES, GRID, GROUPS_SQL, VOX
from voxelloom.functions import naming as N
from voxelloom.functions.shape import phenotype_by_shape  # noqa: F401
from voxelloom.operators import evaluate as E
from voxelloom.operators import objects as O
from voxelloom.operators import splits as SP
from voxelloom.operators import stats as S
from voxelloom.operators.ordered import dense_index, prefix_totals
from voxelloom.plans.mapping import SPECIMEN
from voxelloom.plans.measure import rounded
from voxelloom.plans.registry import query

METRICS = ["l_quantity", "l_extendedprice", "l_discount"]
LONG = """WITH lg AS (SELECT l_returnflag dataset, metric, value FROM (
   SELECT l_returnflag, 'l_quantity' metric, l_quantity value FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem
   UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem) WHERE l_returnflag IN ('A','R')),
 sm AS (SELECT metric, count(*) FILTER (dataset='A') n_a, avg(value) FILTER (dataset='A') mean_a, median(value) FILTER (dataset='A') median_a, stddev_samp(value) FILTER (dataset='A') std_a,
   count(*) FILTER (dataset='R') n_b, avg(value) FILTER (dataset='R') mean_b, median(value) FILTER (dataset='R') median_b, stddev_samp(value) FILTER (dataset='R') std_b FROM lg GROUP BY 1)"""
MW = """hh AS (SELECT metric, value, count(*) FILTER (dataset='A') a, count(*) m FROM lg GROUP BY 1,2),
 rr AS (SELECT *, sum(m) OVER (PARTITION BY metric ORDER BY value)-m+(m+1)/2.0::DOUBLE mid FROM hh),
 uu AS (SELECT metric, sum(a*mid)-sum(a)*(sum(a)+1)/2.0::DOUBLE u, sum(a)::BIGINT n_a, (sum(m)-sum(a))::BIGINT n_b, sum(m::DOUBLE*m*m-m) ties FROM rr GROUP BY 1)"""


def long(t):
    g = t.two_groups
    return S.long_frame(g.where("dataset = 'A'"), g.where("dataset = 'R'"), METRICS, ("A", "R"))


_SUM6 = ["mean_a", "median_a", "std_a", "mean_b", "median_b", "std_b", "ratio_mean"]


@query("sta_1_two_sample_summary", f"{LONG} SELECT metric, n_a, n_b, {', '.join(f'round({c},6) {c}' for c in _SUM6[:-1])}, round(mean_b/mean_a,6) ratio_mean FROM sm")
def _(t):
    return rounded(S.two_sample_summary(long(t), "A", "R"), *_SUM6)


@query("sta_2_welch_t", f"""{LONG}, v AS (SELECT *, std_a*std_a/n_a va, std_b*std_b/n_b vb FROM sm)
  SELECT metric, round((mean_a-mean_b)/sqrt(va+vb),6) welch_t, round(pow(va+vb,2)/(va*va/(n_a-1)+vb*vb/(n_b-1)),4) welch_df FROM v""")
def _(t):
    out = S.welch(S.two_sample_summary(long(t), "A", "R"))
    return out.select("metric", F.round("welch_t", 6).alias("welch_t"), F.round("welch_df", 4).alias("welch_df"))


@query("sta_2_welch_p")
def _(t):
    return S.welch(S.two_sample_summary(long(t), "A", "R")).select("metric", "welch_t", "welch_df", "welch_p")


@query("sta_3_mann_whitney_u", f"{LONG}, {MW} SELECT metric, n_a, n_b, round(u,1) mw_u FROM uu")
def _(t):
    return S.mann_whitney(long(t), "A", "R").select("metric", "n_a", "n_b", F.round("mw_u", 1).alias("mw_u"))


@query("sta_3_mann_whitney_p")
def _(t):
    return S.mann_whitney(long(t), "A", "R")


@query("sta_4_fdr", """WITH p AS (SELECT p_partkey, (p_size*p_size+p_partkey%7)/3000.0::DOUBLE pv FROM part),
  r AS (SELECT *, row_number() OVER (ORDER BY pv, p_partkey) rn, count(*) OVER () m FROM p),
  q AS (SELECT *, least(1.0, min(pv*m/rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) q FROM r)
  SELECT p_partkey, round(pv,9) pv, round(q,9) p_fdr_bh, q<=0.05 significant FROM q""")
def _(t):
    p = t.table("part").selectExpr("p_partkey", "(p_size*p_size+p_partkey%7)/3000.0D pv")
    return rounded(S.benjamini_hochberg(p, "pv", "p_partkey"), "pv", "p_fdr_bh", digits=9)


@query("sta_5_cohens_d", f"""{LONG} SELECT metric, round((mean_b-mean_a)/sqrt(((n_a-1)*std_a*std_a+(n_b-1)*std_b*std_b)/(n_a+n_b-2)),6) cohens_d,
  round((mean_a-mean_b)/sqrt((std_a*std_a+std_b*std_b)/2),6) cohens_d_mean_variance FROM sm""")
def _(t):
    s = S.two_sample_summary(long(t), "A", "R")
    return s.select("metric", F.round(S.cohens_d(), 6).alias("cohens_d"), F.round(S.cohens_d_mean_variance(), 6).alias("cohens_d_mean_variance"))


@query("sta_6_rank_biserial", f"{LONG}, {MW} SELECT metric, round(1-2*u/(n_a*n_b),6) rank_biserial FROM uu")
def _(t):
    mw = S.mann_whitney(long(t), "A", "R")
    return mw.select("metric", F.round(S.rank_biserial(F.col("mw_u"), F.col("n_a"), F.col("n_b")), 6).alias("rank_biserial"))


@query("sta_7_compare_datasets", f"""{LONG} SELECT metric, round(mean_a,6) mean_a, round(std_a/mean_a,6) cv_a, round(mean_b,6) mean_b, round(std_b/mean_b,6) cv_b,
  round(mean_b/mean_a,6) ratio_mean FROM sm""")
def _(t):
    return rounded(S.compare_datasets(long(t), "A", "R"), "mean_a", "cv_a", "mean_b", "cv_b", "ratio_mean")


_CORR = ["sd", "bt", "ft", "f1_score", "sbd_score"]


@query("sta_8_correlations", GRID + " " + " UNION ALL ".join(
    f"SELECT '{a}' a, '{b}' b, round(corr({a},{b}),6) r FROM grid" for i, a in enumerate(sorted(_CORR)) for b in sorted(_CORR)[i:]))
def _(t):
    return rounded(S.correlations(t.grid, _CORR), "r")


@query("sta_9_by_parameter", GRID + " " + " UNION ALL ".join(
    f"""SELECT '{p}' AS "parameter", {p} parameter_value, round(avg(f1_score),4) f1_score_mean, round(stddev_samp(f1_score),4) f1_score_std, count(f1_score) f1_score_count,
    round(avg(sbd_score),4) sbd_score_mean, round(stddev_samp(sbd_score),4) sbd_score_std, count(sbd_score) sbd_score_count FROM grid GROUP BY 2""" for p in ("sd", "bt", "ft")))
def _(t):
    return S.by_parameter(t.grid, ["sd", "bt", "ft"], ["f1_score", "sbd_score"])


@query("sta_10_pivot_means", GRID + " SELECT sd, " + ", ".join(f'round(avg(f1_score) FILTER (bt={i}),6) "{i}"' for i in range(1, 5)) + " FROM grid GROUP BY 1")
def _(t):
    return rounded(S.pivot_means(t.grid, "sd", "bt", [1, 2, 3, 4], "f1_score"), "1", "2", "3", "4")


_DESC = ["mean", "std", "min", "max", "p25", "p50", "p75"]


def _describe_sql(src, cols, by=""):
    return " UNION ALL ".join(f"""SELECT {by} '{c}' metric, count({c}) n, round(avg({c}),6) mean, round(stddev_samp({c}),6) std, round(min({c}),6) "min", round(max({c}),6) "max",
      round(quantile_cont({c},0.25),6) p25, round(quantile_cont({c},0.5),6) p50, round(quantile_cont({c},0.75),6) p75 FROM {src}""" for c in cols)


@query("sta_11_describe", GRID + " " + _describe_sql("grid", ["f1_score", "sbd_score"]))
def _(t):
    return rounded(S.describe(t.grid, ["f1_score", "sbd_score"]), *_DESC)


@query("sta_12_anomalies", GRID + """ SELECT count(*) FILTER (f1_score=1) perfect_f1, count(*) FILTER (sbd_score>0.9999) perfect_sbd, count(*) FILTER (f1_score>0.99) near_perfect_f1 FROM grid""")
def _(t):
    return S.anomalies(t.grid, "f1_score", "sbd_score")


@query("sta_13_parameter_values", GRID + " " + " UNION ALL ".join(f"""SELECT DISTINCT '{p}' AS "parameter", {p} AS "value" FROM grid""" for p in ("sd", "bt", "ft")))
def _(t):
    return S.parameter_values(t.grid, ["sd", "bt", "ft"])


_Z = "1.959964::DOUBLE"


@query("sta_14_class_proportions", f"""WITH c AS (SELECT event_type, count(*) k FROM events GROUP BY 1), n AS (SELECT sum(k)::BIGINT n FROM c), p AS (SELECT *, k/n::DOUBLE p FROM c, n)
  SELECT event_type, k, n, round(p,6) proportion, round((p+{_Z}*{_Z}/(2*n)-{_Z}*sqrt(p*(1-p)/n+{_Z}*{_Z}/(4*n*n)))/(1+{_Z}*{_Z}/n),6) ci_low,
  round((p+{_Z}*{_Z}/(2*n)+{_Z}*sqrt(p*(1-p)/n+{_Z}*{_Z}/(4*n*n)))/(1+{_Z}*{_Z}/n),6) ci_high FROM p""")
def _(t):
    return rounded(S.class_proportions(t.table("events"), "event_type"), "proportion", "ci_low", "ci_high")


@query("sta_15_cluster")
def _(t):
    li = t.table("lineitem").groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.stddev_samp("l_tax").alias("tax"), F.lit(1.0).alias("flat"))
    return S.cluster(li, ["quantity", "discount", "tax", "flat"], range(2, 4))


@query("sta_16_ecdf", """SELECT DISTINCT event_type, value, count(*) OVER (PARTITION BY event_type, value) n, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value),9) ecdf FROM events""")
def _(t):
    return rounded(S.ecdf(t.table("events"), ["event_type"], "value"), "ecdf", digits=9)


@query("sta_16_box_table", """SELECT event_type, round(quantile_cont(value,0.25),6) q1, round(quantile_cont(value,0.5),6) median, round(quantile_cont(value,0.75),6) q3 FROM events GROUP BY 1""")
def _(t):
    return rounded(S.box_table(t.table("events"), ["event_type"], "value"), "q1", "median", "q3")


@query("sta_16_discrete_counts", "SELECT l_returnflag AS class, l_linenumber::BIGINT AS value, count(*) n FROM lineitem GROUP BY 1,2")
def _(t):
    return t.table("lineitem").groupBy(F.col("l_returnflag").alias("class"), F.col("l_linenumber").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("sta_17_long_frame", f"{LONG} SELECT dataset, metric, count(*) n, round(sum(value),2) total FROM lg GROUP BY 1,2")
def _(t):
    return long(t).groupBy("dataset", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("sta_18_parameter_grid", f"""{VOX} SELECT volume_id, sd::BIGINT sd, bp, ft, bt, 'sd'||sd||'_bp'||replace(bp::VARCHAR,'.','')||'_ft'||replace(ft::VARCHAR,'.','')||'_bt'||replace(bt::VARCHAR,'.','') tag
  FROM vol, (VALUES (1),(2),(3)) a(sd), (VALUES (1.0::DOUBLE),(1.5),(2.5)) b(bp), (VALUES (0.5::DOUBLE),(0.6),(0.7)) c(ft), (VALUES (0.05::DOUBLE),(0.08),(0.12)) d(bt)""")
def _(t):
    grid = S.parameter_grid(t.volumes.select("volume_id"), sd=[1, 2, 3], bp=[1.0, 1.5, 2.5], ft=[0.5, 0.6, 0.7], bt=[0.05, 0.08, 0.12])
    tag = N.parameter_tag(**{c: F.col(c) for c in ("sd", "bp", "ft", "bt")})
    return grid.select("volume_id", F.col("sd").cast("long").alias("sd"), "bp", "ft", "bt", tag.alias("tag"))


# ------------------------------------------------------------------ windows
@query("win_1_first_match", f"""{VOX}, c AS (SELECT volume_id, gt, cell, count(*) n FROM vox WHERE gt>0 AND cell>0 GROUP BY 1,2,3)
  SELECT volume_id, gt, cell AS best, n AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY volume_id,gt ORDER BY n DESC, cell) r FROM c) WHERE r=1""")
def _(t):
    return O.majority(O.contingency(t.vox.where("gt > 0 and cell > 0"), "gt", "cell"), ["volume_id", "gt"], "cell", "best")


@query("win_2_dense_index", "SELECT event_type, user_id, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) idx, n FROM (SELECT event_type, user_id, count(*) n FROM events GROUP BY 1,2)")
def _(t):
    return dense_index(t.table("events"), ["event_type"], "user_id", "idx").groupBy("event_type", "user_id", "idx").agg(F.count(F.lit(1)).alias("n"))


@query("win_3_average_rank", """SELECT DISTINCT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value)+(count(*) OVER (PARTITION BY event_type,value)-1)/2.0::DOUBLE avg_rank FROM events""")
def _(t):
    hist = t.table("events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    run = prefix_totals(hist, ["event_type"], ["value"], ["n"])
    return run.select("event_type", "value", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("avg_rank"))


@query("win_4_step_up_minimum", """SELECT c_custkey, round(min(c_acctbal) OVER (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),2) tail_min FROM customer""")
def _(t):
    from voxelloom.operators.ordered import suffix_minimum
    out = suffix_minimum(t.table("customer").select("c_custkey", "c_acctbal"), ["c_custkey"], "c_acctbal", "tail_min")
    return out.select("c_custkey", F.round("tail_min", 2).alias("tail_min"))


@query("win_5_running_hits", f"""{VOX}, h AS (SELECT volume_id, fg, count(*) FILTER (gt>0) pos, count(*) a FROM vox GROUP BY 1,2)
  SELECT volume_id, fg, (sum(pos) OVER w)::BIGINT tp, (sum(a-pos) OVER w)::BIGINT fp FROM h WINDOW w AS (PARTITION BY volume_id ORDER BY fg DESC)""")
def _(t):
    hist = t.vox.groupBy("volume_id", "fg").agg(F.count(F.when(F.col("gt") > 0, 1)).alias("pos"), F.count(F.lit(1)).alias("all"))
    run = prefix_totals(hist, ["volume_id"], [F.col("fg").desc()], ["pos", "all"])
    return run.select("volume_id", "fg", F.col("cum_pos").alias("tp"), (F.col("cum_all") - F.col("cum_pos")).alias("fp"))


@query("win_8_nearest_annotated", f"""{VOX}, s AS (SELECT volume_id, z, count(*) FILTER (raw=7 AND gt>0 AND z%2=0)>0 has FROM vox GROUP BY 1,2)
  SELECT volume_id, z, last_value(CASE WHEN has THEN z END IGNORE NULLS) OVER (PARTITION BY volume_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before_z,
   first_value(CASE WHEN has THEN z END IGNORE NULLS) OVER (PARTITION BY volume_id ORDER BY z ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) after_z FROM s""")
def _(t):
    from voxelloom.operators.gaps import nearest_slices
    flags = t.vox.groupBy("volume_id", "z").agg(F.max(F.expr("raw = 7 and gt > 0 and z % 2 = 0")).alias("has"))
    return nearest_slices(flags).select("volume_id", "z", "before_z", "after_z")


@query("win_9_cume_dist", "SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity),9) ecdf FROM lineitem")
def _(t):
    return rounded(S.ecdf(t.table("lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", "l_quantity", "ecdf"), "ecdf", digits=9)


@query("win_10_positional", f"""{FILES}, r AS (SELECT path, row_number() OVER (ORDER BY path) rn, count(*) OVER () n FROM files)
  SELECT path, rn<=floor(n*0.8::DOUBLE) in_head FROM r""")
def _(t):
    run = prefix_totals(t.files.select("path"), [], ["path"])
    return run.select("path", (F.col("rn") <= F.floor(F.col("rows_total") * 0.8)).alias("in_head"))


# ------------------------------------------------------------------ sort and sets
@query("srt_1_top_runs", GRID + " SELECT dataset, f1_score FROM grid ORDER BY f1_score DESC, run_no LIMIT 10")
def _(t):
    return t.grid.orderBy(F.col("f1_score").desc(), "run_no").limit(10).select("dataset", "f1_score")


@query("srt_2_leaderboard", "SELECT l_returnflag||l_linestatus model, round(avg(l_discount),6) ap FROM lineitem GROUP BY 1 ORDER BY ap DESC, model")
def _(t):
    return t.table("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg(
        F.round(F.avg("l_discount"), 6).alias("ap")).orderBy(F.col("ap").desc(), "model")


@query("srt_3_common_shapes", f"{VOX} SELECT nz, ny, nx, count(*) n FROM vol GROUP BY 1,2,3 ORDER BY n DESC")
def _(t):
    return t.volumes.groupBy("nz", "ny", "nx").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "nz", "ny", "nx")


@query("set_1_diagonal_concat", f"""{VOX} SELECT volume_id, count(*) FILTER (gt>0) gt_fg, NULL::BIGINT pred_fg FROM vox GROUP BY 1
  UNION ALL SELECT volume_id, NULL, count(*) FILTER (pred>0) FROM vox GROUP BY 1""")
def _(t):
    a = t.vox.groupBy("volume_id").agg(F.count(F.when(F.col("gt") > 0, 1)).alias("gt_fg"))
    b = t.vox.groupBy("volume_id").agg(F.count(F.when(F.col("pred") > 0, 1)).alias("pred_fg"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_2_present_ids", f"{VOX} SELECT DISTINCT volume_id, group_id::BIGINT group_id, pred AS label FROM vox JOIN {GROUPS_SQL} ON pred=label")
def _(t):
    present = t.labels("pred").select("volume_id", "label").distinct()
    return present.join(t.label_groups, "label").select("volume_id", "group_id", "label")


@query("set_3_difference", f"{SPECIMEN} SELECT DISTINCT source, genotype FROM spec EXCEPT SELECT source, genotype FROM spec WHERE file_id<2")
def _(t):
    spec = t.files.select("file_id", F.inline(F.array(N.specimen(F.col("path")))))
    return spec.select("source", "genotype").distinct().exceptAll(spec.where("file_id < 2").select("source", "genotype").distinct())


@query("set_4_dedupe_ordered", "SELECT user_id, min(event_id) first_pos FROM events GROUP BY 1")
def _(t):
    return SP.dedupe_ordered(t.table("events"), "user_id", "event_id").select("user_id", F.col("event_id").alias("first_pos"))


@query("set_5_mask_union", f"{VOX} SELECT volume_id, z, y, x FROM vox WHERE cell=1 UNION SELECT volume_id, z, y, x FROM vox WHERE gt=1")
def _(t):
    from voxelloom.operators.labels import union_masks
    return union_masks(t.vox.where("cell = 1"), t.vox.where("gt = 1"))
