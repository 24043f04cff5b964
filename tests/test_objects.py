import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions.shape import voxel_size_um
from voxelloom.operators import lattice as L
from voxelloom.operators import objects as O
from voxelloom.operators.cells import qc_objects


def padded(shape, box, label=1):
    a = np.zeros(shape, np.int64)
    a[box] = label
    return a


def measures(frame, shapes, a, block=(3, 3, 3), size=(1.0, 1.0, 1.0)):
    return {r.label: r for r in O.lattice_measures(frame(a), shapes(a), size, block).collect()}


def test_solid_box(frame, shapes):
    m = measures(frame, shapes, padded((6, 7, 8), np.s_[2:4, 2:5, 2:6]))[1]
    assert m.euler_char == 1 and m.exposed_faces == 52


def test_ring_has_euler_zero(frame, shapes):
    a = padded((3, 5, 5), np.s_[1:2, 1:4, 1:4])
    a[1, 2, 2] = 0
    assert measures(frame, shapes, a)[1].euler_char == 0


def test_two_boxes_at_a_corner_are_one_piece(frame, shapes):
    a = padded((6, 6, 6), np.s_[1:3, 1:3, 1:3])
    a[3:5, 3:5, 3:5] = 1
    assert measures(frame, shapes, a)[1].euler_char == 1


def test_block_size_does_not_matter(frame, shapes):
    a = np.random.default_rng(1).integers(0, 4, (7, 9, 8))
    got = [measures(frame, shapes, a, b, (2.0, 1.0, 0.5)) for b in ((2, 3, 4), (16, 16, 16))]
    for lab in got[0]:
        for c in ("euler_char", "exposed_faces"):
            assert got[0][lab][c] == got[1][lab][c]
        assert got[0][lab].surface_um2 == pytest.approx(got[1][lab].surface_um2)


def test_iso_surface_of_a_box_and_a_ball():
    assert L.iso_area(0, (1, 1, 1)) == L.iso_area(255, (1, 1, 1)) == 0
    # a voxel alone is an octahedron with half-unit arms
    single = sum(L.iso_area(1 << k, (1, 1, 1)) for k in range(8))
    assert single == pytest.approx(math.sqrt(3))


def test_iso_surface_of_a_ball(frame, shapes):
    r = 8
    g = np.indices((2 * r + 5,) * 3) - (r + 2)
    ball = ((g ** 2).sum(0) <= r * r).astype(np.int64)
    area = measures(frame, shapes, ball, (64, 64, 64))[1].surface_um2
    assert 1.0 < area / (4 * math.pi * r * r) < 1.12


def test_surface_is_open_at_the_volume_border(frame, shapes):
    a = np.ones((4, 4, 4), np.int64)
    assert measures(frame, shapes, a)[1].surface_um2 is None


def test_every_byte_is_consistent_with_its_complement():
    for c in range(256):
        assert L.face_quarters(c) == L.face_quarters(255 - c)


def test_degenerate_axes_are_null(frame):
    one, line = np.zeros((3, 3, 3), np.int64), np.zeros((3, 3, 3), np.int64)
    one[1, 1, 1] = 1
    line[1, 1, :2] = 1
    got = {r.volume_id: r for r in O.principal_axes(frame(one, line), (1.0, 1.0, 1.0)).collect()}
    assert got[0].a_um is None and got[0].elongation_a_over_c is None
    assert got[1].a_um == pytest.approx(math.sqrt(0.5)) and got[1].c_um == 0 and got[1].elongation_a_over_c is None


def test_axes_match_an_eigen_solver(frame):
    a = (np.random.default_rng(3).random((6, 7, 8)) < 0.4).astype(np.int64)
    size = np.array([0.03, 0.01, 0.02])
    ev = np.sort(np.linalg.eigvalsh(np.cov((np.argwhere(a) * size).T)))[::-1]
    r = O.principal_axes(frame(a), tuple(size)).first()
    assert [r.a_um, r.b_um, r.c_um] == pytest.approx(list(np.sqrt(ev)), rel=1e-9)


def test_axes_of_a_cube_are_equal(frame):
    r = O.principal_axes(frame(np.ones((3, 3, 3), np.int64)), (1.0, 1.0, 1.0)).first()
    assert r.a_um == pytest.approx(r.c_um) and r.elongation_a_over_c == pytest.approx(1.0)


def test_majority_tie_takes_the_smaller_id(spark):
    rows = [(0, 0, 0, i, 1, c) for i, c in enumerate([9, 9, 4, 4, 0, 0, 0])]
    df = spark.createDataFrame(rows, "volume_id long, z long, y long, x long, label long, cell long")
    assert O.assign_cell(df).first().cell_id == 4


def test_nearest_object_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(0, 0.5, (150, 3)), rng.uniform(-400, 400, (40, 3)), [[7, 7, 7], [7, 7, 7]]])
    rows = [(0, i, *map(float, p)) for i, p in enumerate(pts)] + [(1, 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "volume_id long, label long, centroid_z_um double, centroid_y_um double, centroid_x_um double")
    got = {(r.volume_id, r.label): r.nearest_neighbor_um for r in O.nearest_object(df, 0.5).collect()}
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(rows) and got[(1, 0)] is None
    for i in range(len(pts)):
        assert got[(0, i)] == pytest.approx(d[i].min())


def test_sizes_sum_to_foreground(frame):
    a = np.random.default_rng(2).integers(0, 5, (5, 6, 7))
    assert O.voxel_count(frame(a)).agg(F.sum("volume_vx")).first()[0] == (a > 0).sum()


def test_qc_uses_only_existing_columns(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 3.0)], "label_id long, mean_intensity double")
    assert [r.label_id for r in qc_objects(df).collect()] == [2]


def test_voxel_size_rule(spark):
    df = spark.sql("select explode(array(array(8D), array(30D, 5D), array(30D, 6D, 5D))) nm").select(voxel_size_um(F.col("nm")).alias("s"))
    got = [tuple(round(v, 6) for v in r.s) for r in df.collect()]
    assert got == [(0.008, 0.008, 0.008), (0.03, 0.005, 0.005), (0.03, 0.006, 0.005)]
