"""Registered queries against their SQL twins.

A sample of every family runs by default; ``VOXELLOOM_ALL=1`` runs them all.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import canonical, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = """obj_2_bounding_box obj_7_principal_axes obj_8_euler obj_9_exposed_faces obj_13_cell_assignment obj_20_rois agg_1_cell_table agg_4_cell_level_summary
agg_6_instance_stats agg_19_state_composition agg_20_duplicate_files prj_3_group_remap prj_15_percentile_normalise prj_17_specimen jn_1_label_file jn_5_coarse_lookup
jn_7_iou evl_1_binary_scores evl_2_instance_matching evl_7_average_precision evl_8_roc_auc evl_11_hd95 sta_1_two_sample_summary sta_3_mann_whitney_u sta_4_fdr
sta_9_by_parameter spl_1_grouped_stratified spl_5_group_criteria win_8_nearest_annotated set_3_difference vol_2_halo_box_sum vol_4_largest_component vol_13_grow_labels
vol_16_fill_holes vol_18_merge_segmentations shp_3_nearest shp_4_linear src_2_zarr_pruned src_13_append_scores stm_1_pick_up stm_2_score_ledger""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("VOXELLOOM_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    want = canonical([c[0] for c in res.description], res.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
