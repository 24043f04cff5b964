import numpy as np
import pytest

from voxelloom.operators import envelope as V

SITES = "volume_id long, z long, y long, x long, label long"


def brute(asking, sites, spacing):
    out = {}
    for v, *p in asking:
        own = [(sum(((a - b) * s) ** 2 for a, b, s in zip(p, q, spacing)), lab) for w, *q, lab in sites if w == v]
        least = min((d for d, _ in own), default=None)
        out[v, *p] = (None, None) if least is None else (least**0.5, min(lab for d, lab in own if d <= least * (1 + 1e-12)))
    return out


@pytest.mark.parametrize("spacing", [(1, 1, 1), (0.025, 0.005, 0.005), (2.0, 1.0, 1.5), (0.7310001, 1.0, 3.1415926)])
@pytest.mark.parametrize("kind", ["dense", "sparse", "far", "lattice"])
def test_nearest_site_is_the_nearest(spark, kind, spacing):
    rng = np.random.default_rng(2)
    if kind == "lattice":  # many ties
        sites = [(0, int(z), int(y), int(x), int(z * 7 + y * 3 + x) % 5) for z in range(0, 9, 4) for y in range(0, 33, 8) for x in range(0, 33, 8)]
        asking = [(0, int(z), int(y), int(x)) for z, y, x in rng.integers(0, 33, (150, 3))]
    else:
        side, n = {"dense": (18, 400), "sparse": (70, 9), "far": (400, 3)}[kind]
        sites = [(int(v), *map(int, p), int(lab)) for v, p, lab in zip(rng.integers(0, 3, n), rng.integers(-5, side, (n, 3)), rng.integers(1, 9, n))]
        asking = [(int(v), *map(int, p)) for v, p in zip(rng.integers(0, 4, 150), rng.integers(-5, side, (150, 3)))]  # volume 3 has no sites
    asking = sorted(set(asking))
    got = V.nearest_site(spark.createDataFrame(asking, "volume_id long, z long, y long, x long"), spark.createDataFrame(sites, SITES), spacing).collect()
    want = brute(asking, sites, spacing)
    assert len(got) == len(asking)
    for r in got:
        d, lab = want[r.volume_id, r.z, r.y, r.x]
        assert (r.dist is None) == (d is None) and (d is None or r.dist == pytest.approx(d))
        if V.integer_weights(spacing)[2] is np.int64:
            assert r.label == lab


def test_no_rows(spark):
    some = spark.createDataFrame([(0, 1, 1, 1, 5)], SITES)
    assert V.nearest_site(some.limit(0), some).count() == 0
    assert [(r.dist, r.label) for r in V.nearest_site(some, some.limit(0)).collect()] == [(None, None)]


def test_keys_keep_sides_apart(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 0, 0, 9, 1)], "volume_id long, z long, y long, x long, side long")
    got = V.nearest_site(rows, rows.withColumn("side", 1 - rows.side), keys=("volume_id", "side")).collect()
    assert sorted((r.side, r.dist, r.label) for r in got) == [(0, 9.0, 0), (1, 9.0, 0)]


def test_work_per_voxel_is_constant():
    """Whatever the side of the volume and the distances in it."""
    rng = np.random.default_rng(4)
    for share in (0.02, 0.5):
        per = []
        for side in (32, 64, 128, 256):
            height = np.where(rng.random((side, 256)) < share, rng.integers(0, side * side, (side, 256)), V.far_of(np.int64))
            _, _, steps = V.sweep(height, np.ones_like(height), np.arange(side), np.arange(side), 1, V.far_of(np.int64))
            per.append(steps / side)
        assert max(per) < 12 and per[-1] < 1.8 * per[0]


def test_sweep_ties_and_long_lines():
    far = V.far_of(np.int64)
    height = np.array([[0], [3], [4], [3], [0]])
    best, which, _ = V.sweep(height, np.array([[5], [2], [1], [3], [4]]), np.arange(5), np.arange(5), 1, far)
    assert best.ravel().tolist() == [0, 1, 4, 1, 0] and which.ravel().tolist() == [5, 5, 1, 4, 4]
    with pytest.raises(ValueError):
        V.sweep(np.zeros((2, 1), np.int64), np.zeros((2, 1), np.int64), np.array([0, 2_000_000]), np.array([0]), 1, far)


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_short_lines_as_long_ones(kind):
    rng = np.random.default_rng(8)
    far = V.far_of(kind)
    for share, names in ((0.1, 4), (0.8, 4), (0.5, 1), (0.0, 4)):
        height = np.where(rng.random((20, 64)) < share, rng.integers(0, 60, (20, 64)), far).astype(kind)
        label = rng.integers(1, names + 1, height.shape)
        pos, at = np.sort(rng.choice(40, 20, replace=False)), np.arange(-2, 44, 3)
        one, two = V.sweep(height, label, pos, at, 2, far)[:2], V.compare(height, label, pos, at, 2, far)
        assert all(np.array_equal(a, b) for a, b in zip(one, two))


def test_short_lines_take_few_steps(monkeypatch):
    """Lines of a small volume do not go through the envelope."""
    monkeypatch.setattr(V, "sweep", None)
    best, _ = V.lowest(np.zeros((4, 9), np.int64), np.ones((4, 9), np.int64), np.arange(4), np.arange(30), 1, V.far_of(np.int64))
    assert best[:, 0].tolist() == [0] * 4 + [(i - 3) ** 2 for i in range(4, 30)]
