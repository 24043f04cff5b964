import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import dense
from voxelloom.operators import blocks as B
from voxelloom.operators import components as C
from voxelloom.operators import distance as D
from voxelloom.operators import edit as E
from voxelloom.operators import labels as LB
from voxelloom.operators import morphology as M
from voxelloom.operators import resample as R
from voxelloom.operators import watershed as W
from voxelloom.plans.catalog import QUERIES


def flood(values, offs):
    """Sequential flood fill: component number per voxel, 0 background."""
    out = np.zeros(values.shape, np.int64)
    n = 0
    for start in map(tuple, np.argwhere(values != 0)):
        if out[start]:
            continue
        n += 1
        out[start] = n
        stack = [start]
        while stack:
            p = stack.pop()
            for o in offs:
                q = tuple(a + b for a, b in zip(p, o))
                if all(0 <= c < s for c, s in zip(q, values.shape)) and not out[q] and values[q] == values[p]:
                    out[q] = n
                    stack.append(q)
    return out


def partition(a):
    return {frozenset(map(tuple, np.argwhere(a == v))) for v in np.unique(a) if v}


@pytest.mark.parametrize("conn", [6, 18, 26])
@pytest.mark.parametrize("block", [(2, 3, 4), (16, 16, 16)])
def test_components_equal_flood_fill(frame, conn, block):
    a = np.random.default_rng(conn).integers(0, 3, (7, 8, 9))
    got = dense(C.components(frame(a), conn, True, block), a.shape, "component") + (a > 0)
    assert partition(got) == partition(flood(a, LB.offsets(conn)))


def test_component_ids_do_not_depend_on_blocks(frame):
    a = (np.random.default_rng(0).random((6, 9, 9)) < 0.35).astype(np.int64)
    got = [sorted(map(tuple, C.components(frame(a), 26, False, b).select("z", "y", "x", "component").collect())) for b in ((2, 2, 2), (4, 5, 3), (64, 64, 64))]
    assert got[0] == got[1] == got[2]


def test_corner_contact(frame):
    a = np.zeros((4, 4, 4), np.int64)
    a[:2, :2, :2] = 1
    a[2:, 2:, 2:] = 1
    for conn, n in ((26, 1), (6, 2)):
        assert C.component_sizes(C.components(frame(a), conn, True, (2, 2, 2))).count() == n


def test_chain_through_many_blocks(frame):
    a = np.zeros((1, 1, 64), np.int64)
    a[0, 0, :] = 1
    sizes = C.component_sizes(C.components(frame(a), 6, True, (1, 1, 2))).collect()
    assert [r["size"] for r in sizes] == [64]


def test_flat_labels_survive_cleaning(frame):
    a = np.zeros((10, 10, 10), np.int64)
    a[0, 2:8, 2:8], a[2, 2:8, 2:8], a[4] = 1, 2, 3
    out = C.largest_per_label(frame(a), block=(4, 4, 4))
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {1: 36, 2: 36, 3: 100}


def test_tiny_object_inside_another_goes(frame):
    a = np.ones((20, 20, 20), np.int64)
    a[0, 0, 0] = 99
    out = dense(C.drop_small_components(frame(a), 10, block=(8, 8, 8)), a.shape)
    assert out[0, 0, 0] == 0 and (out == 1).sum() == 7999


def test_white_patches(frame, spark):
    flat, cube = np.zeros((1, 20, 20), np.int64), np.zeros((10, 10, 10), np.int64)
    flat[0, 2:7, 2:7] = flat[0, 10:15, 10:15] = 255
    cube[2:5, 2:5, 2:5] = cube[8, 8, 8] = 255
    rows = frame(flat, cube, name="raw")
    out = C.zero_patches(rows, "raw", F.col("raw") == 255, 20, block=(4, 4, 4)).where("raw = 255")
    assert [(r.volume_id, r.z, r.y, r.x) for r in out.collect()] == [(1, 8, 8, 8)]


@pytest.mark.parametrize("radius", [1, 3])
def test_distance_equals_brute_force(frame, shapes, radius):
    a = np.ones((6, 9, 10), np.int64)
    a[2, 1, 1] = a[5, 8, 9] = a[0, 8, 3] = 0
    spacing = (2.0, 1.0, 1.5)
    out = dense(D.distance(frame(a), shapes(a), radius, spacing, block=(3, 4, 4)), a.shape, "dist", dtype=float)
    bg = np.argwhere(a == 0) * spacing
    for p in map(tuple, np.argwhere(a)):
        assert out[p] == pytest.approx(np.linalg.norm(bg - np.array(p) * spacing, axis=1).min())


def test_distance_without_background_is_null(frame, shapes):
    a = np.ones((2, 3, 3), np.int64)
    assert D.distance(frame(a), shapes(a), 2).where("dist is not null").count() == 0


def brute_watershed(h, seeds, mask):
    """Flooding voxel by voxel from the seeds: always the cheapest edge first."""
    offs, inside = LB.offsets(6), lambda q: all(0 <= c < s for c, s in zip(q, h.shape)) and mask[q]
    spots = np.argwhere((seeds > 0) & mask)
    rank = {tuple(p): (h[tuple(p)], float(np.sqrt(((spots - p) ** 2).sum(1).min())) if len(spots) else 0.0, tuple(p)) for p in np.argwhere(mask)}
    out, heap = np.zeros(h.shape, np.int64), []

    def reach(p, label):
        out[p] = label
        for o in offs:
            q = tuple(int(a + b) for a, b in zip(p, o))
            if inside(q):
                heapq.heappush(heap, (max(rank[p], rank[q]), min(rank[p], rank[q]), q, label))

    for p in map(tuple, spots.tolist()):
        out[p] = seeds[p]
    for p in map(tuple, spots.tolist()):
        reach(p, int(seeds[p]))
    while heap:
        *_, q, label = heapq.heappop(heap)
        if not out[q]:
            reach(q, label)
    return out


@pytest.mark.parametrize("levels, block, few", [(2, (3, 4, 4), 99), (6, (1, 2, 3), 40), (1000, (3, 4, 4), 50_000), (6, (32, 32, 32), 0)])
def test_watershed_equals_sequential_flooding(frame, levels, block, few):
    rng = np.random.default_rng(11 + levels)
    h = rng.integers(1, levels, (5, 9, 10)).astype(float)
    mask = rng.random(h.shape) < 0.8
    seeds = np.zeros(h.shape, np.int64)
    for i, p in enumerate(((0, 0, 0), (4, 8, 9), (2, 4, 5), (2, 4, 7), (0, 8, 0)), 1):
        mask[p], seeds[p] = True, i
    mask[:, 6:9, 1:4] &= False  # the last seed may be cut off, and part of the mask has none
    mask[2, 7, 2] = True
    got = dense(W.watershed(frame(np.where(mask, h, 0), kind="double", name="height"), frame(seeds), block, few), h.shape)
    assert np.array_equal(got, brute_watershed(h, seeds, mask))


def test_floods_meet_half_way_on_a_plateau(frame):
    h, seeds = np.ones((1, 1, 40)), np.zeros((1, 1, 40), np.int64)
    seeds[0, 0, 2], seeds[0, 0, 30] = 7, 3
    out = dense(W.watershed(frame(h, kind="double", name="height"), frame(seeds), (1, 1, 8)), h.shape).ravel().tolist()
    assert out == [7] * 17 + [3] * 23


def test_every_watershed_round_halves_the_graph(frame, monkeypatch):
    """Every round at least halves the basins that are open."""
    from voxelloom.operators import flood

    rounds = []
    real = flood.follow
    monkeypatch.setattr(flood, "follow", lambda up: rounds.append(up.count()) or real(up))
    h = np.random.default_rng(0).random((1, 16, 16)) + 1
    seeds = np.zeros(h.shape, np.int64)
    seeds[0, 0, 0], seeds[0, 15, 15] = 1, 2
    got = dense(W.watershed(frame(h, kind="double", name="height"), frame(seeds), (1, 2, 2), 10), h.shape)
    assert np.array_equal(got, brute_watershed(h, seeds, h > 0))
    assert all(b <= a / 2 for a, b in zip(rounds, rounds[1:])) and len(rounds) <= 6


def test_segment_two_blobs(spark, shapes):
    g = np.indices((5, 16, 30))
    d = np.minimum(*[np.sqrt(((g - np.array(c).reshape(3, 1, 1, 1)) ** 2).sum(0)) for c in ((2, 8, 8), (2, 8, 21))])
    fg, bd = np.where(d < 6, 0.9, 0.05), np.where((d >= 5) & (d < 7), 0.6, 0.05)
    rows = [(0, *map(int, p), float(fg[tuple(p)]), float(bd[tuple(p)])) for p in np.argwhere(fg > -1)]
    vox = spark.createDataFrame(rows, "volume_id long, z long, y long, x long, fg double, bd double")
    p = W.SegParams(seed_distance=3.0, min_size=50)
    out = W.segment(vox, shapes(fg), p, radius=4, block=(5, 8, 8))
    assert out.select("label").distinct().count() == 2
    assert set(W.PRESETS) >= {"out_of_core", "in_core", "axon", "from_prediction", "channel_difference", "decoder"}
    diff = W.segment(vox, shapes(fg), W.SegParams(seed_distance=None, seed_difference=0.6, height="boundary", mask="max", min_size=10), block=(5, 8, 8))
    assert diff.select("label").distinct().count() == 2
    core = W.SegParams(fg_threshold=0.85, bd_threshold=0.15, seed_distance=2.0, seed_connectivity=18, seed_min_size=5, penalty=None,
                       mask="sum_low_boundary", min_size=20, clean=(10, 1, 1))
    assert W.segment(vox, shapes(fg), core, radius=4, block=(5, 8, 8)).select("label").distinct().count() == 2


def np_morph(a, op, elem):
    out = np.zeros_like(a) if op == "dilate" else np.ones_like(a)
    for p in np.ndindex(a.shape):
        vals = []
        for o in elem:
            q = tuple(c + d for c, d in zip(p, o))
            vals.append(a[q] if all(0 <= c < s for c, s in zip(q, a.shape)) else False)
        out[p] = any(vals) if op == "dilate" else all(vals)
    return out


@pytest.mark.parametrize("kind", ["cross", "square", "zline", "cube"])
def test_closing_equals_brute_force(frame, shapes, kind):
    a = np.random.default_rng(8).random((5, 8, 9)) < 0.3
    elem = M.element(kind)
    want = np_morph(np_morph(a, "dilate", elem), "erode", elem)
    got = dense(M.morph(frame(a.astype(np.int64)), M.volume_boxes(shapes(a)), "close", elem, 1, (3, 3, 3)).withColumn("label", F.lit(1)), a.shape)
    assert np.array_equal(got > 0, want)


def test_holes_fill_and_block_size(frame):
    a = np.zeros((6, 9, 9), np.int64)
    a[1:5, 1:8, 1:8] = 1
    a[2:4, 3:5, 3:5] = 0
    a[2, 6, 6] = 0
    for block in ((2, 3, 3), (16, 16, 16)):
        out = dense(M.fill_holes(frame(a), 8, block=block), a.shape)
        assert out[2, 6, 6] == 1 and out[2, 3, 3] == 0
        assert (dense(M.fill_holes(frame(a), 9, block=block), a.shape) > 0).sum() == 4 * 49


def test_cleaning_does_not_depend_on_blocks(frame):
    a = (np.random.default_rng(4).random((5, 10, 10)) < 0.5).astype(np.int64)
    a[:, :, 5:] *= 2
    got = [dense(M.clean_objects(frame(a), 5, 1, 1, b), a.shape) for b in ((3, 4, 4), (32, 32, 32))]
    assert np.array_equal(*got) and ((got[0] > 0) >= (a > 0)).all()


def test_grow_takes_smaller_label_on_ties(frame):
    seeds, mask = np.zeros((1, 1, 5), np.int64), np.ones((1, 1, 5), np.int64)
    seeds[0, 0, 0], seeds[0, 0, 4] = 7, 3
    assert dense(D.grow_labels(frame(seeds), frame(mask)), mask.shape).ravel().tolist() == [7, 7, 3, 3, 3]


def test_merge_replaces_and_renumbers(frame):
    a, b = np.zeros((1, 1, 10), np.int64), np.zeros((1, 1, 10), np.int64)
    a[0, 0, :4], a[0, 0, 6:8] = 1, 2
    b[0, 0, 1:4], b[0, 0, 7:10] = 5, 9
    got = dense(E.merge_segmentations(frame(a), frame(b), 0.5), a.shape).ravel().tolist()
    assert got == [0, 3, 3, 3, 0, 0, 2, 4, 4, 4]


def test_slices_link_across_a_gap(frame):
    a = np.zeros((4, 4, 4), np.int64)
    a[0, :3, :3], a[2, :3, :3], a[3, :3, :3] = 4, 8, 8
    assert E.link_slices(frame(a), 0.5, 1).select("label").distinct().count() == 2
    assert E.link_slices(frame(a), 0.5, 2).select("label").distinct().count() == 1


def test_resample_shapes_and_formula(frame, shapes):
    a = np.arange(1, 65).reshape(4, 4, 4)
    up = dense(R.nearest(frame(a), shapes(a), (8, 8, 8)), (8, 8, 8))
    idx = np.clip(np.round(np.arange(8) * 0.5), 0, 3).astype(int)
    assert np.array_equal(up, a[np.ix_(idx, idx, idx)])
    down = dense(R.pick_evenly(frame(a), shapes(a), (2, 3, 4)), (2, 3, 4))
    sel = [np.linspace(0, 3, n).astype(int) for n in (2, 3, 4)]
    assert np.array_equal(down, a[np.ix_(*sel)])


def test_blocks_cover_the_volume_once(shapes):
    vol = shapes(np.zeros((7, 10, 13)))
    for tail in (0, 2):
        seen = np.zeros((7, 10, 13), int)
        for r in B.block_grid(vol, (3, 4, 6), tail).collect():
            seen[r.z0:r.z1, r.y0:r.y1, r.x0:r.x1] += 1
        assert (seen == 1).all()


def test_offsets_sizes():
    assert [len(LB.offsets(c)) for c in (6, 18, 26)] == [6, 18, 26]
    assert all(len(set(p)) == 3 for p in itertools.combinations(LB.offsets(26), 3))


def test_slices_link_labels_of_any_size(spark):
    """Ids as the component search emits them: far apart in z, equal in their low bits."""
    big = 1 << 42
    rows = [(0, 0, 0, x, big + 1) for x in range(4)] + [(0, 1, 9, x, 1) for x in range(4)] + [(0, 1, 0, x, 5 * big) for x in range(4)]
    out = E.link_slices(spark.createDataFrame(rows, "volume_id long, z long, y long, x long, label long"))
    found = {r.label: r.n for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sorted(found.values()) == [4, 8]


def test_packed_coordinates_fail_beyond_their_range(spark):
    with pytest.raises(Exception, match="beyond the packed range"):
        spark.range(1).select(C.pack(F.lit(1 << 21), F.lit(0), F.lit(0))).collect()


def test_halo_copies_stay_inside_the_volume(spark):
    """Rows near the end of a volume are not sent to blocks that lie behind it."""
    rows = spark.createDataFrame([(0, 3, 5, 5, 4, 6, 6), (0, 3, 5, 5, 5, 7, 6)], "volume_id long, z long, y long, x long, z1 long, y1 long, x1 long")
    got = B.with_blocks(rows, (4, 6, 6), (1, 1, 1), (1, 1, 1), inside=True).select("z1", "bz", "by", "bx").collect()
    assert sorted(map(tuple, got)) == [(4, 0, 0, 0), (5, 0, 0, 0), (5, 0, 1, 0), (5, 1, 0, 0), (5, 1, 1, 0)]


def test_presets_take_each_distance_once(spark, monkeypatch):
    """Sets of one boundary threshold share the distance."""
    made, given, real = [], {}, W.distance

    def segment(vox, volumes, p, radius, block, dist=None):
        given[p] = dist
        return vox.select("volume_id", F.lit(1).alias("label"))

    monkeypatch.setattr(W, "distance", lambda *a, **k: made.append(1) or real(*a, **k))
    monkeypatch.setattr(W, "segment", segment)
    out = QUERIES["vol_12_presets"](spark, "/root/testdata/sf0.001")
    wanting = [p for p in given if p.flood and p.height == "distance"]
    assert len(wanting) == 3 and all(given[p] is not None for p in wanting) and len(made) == 2
    assert {r.preset for r in out.select("preset").collect()} == set(W.PRESETS)
