import numpy as np
import pytest

from voxelloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, _v string"


def plain(rows, k, rounds, width):
    """The same rule without any filter."""
    import hashlib

    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(v) for _, v in order[:k]]

    def pick(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        where = [pick(v)[1] for _, v in kept]
        for n in range(len(cs)):
            own = [v for (_, v), w in zip(kept, where) if w == n]
            if own:
                cs[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, pick(v)[1], pick(v)[0]) for i, v in kept), key=repr), cs


def rows_for(kind):
    rng = np.random.default_rng(5)
    if kind == "spread":
        made = rng.normal(size=(300, 8))
    elif kind == "groups":
        made = rng.integers(-3, 3, (12, 8))[rng.integers(0, 12, 300)] * 4 + rng.normal(size=(300, 8)) * 0.1
    elif kind == "ties":
        made = rng.integers(0, 2, (300, 8)).astype(float)
    elif kind == "flat":  # all on one line: only two pivots can be taken
        made = np.outer(rng.integers(-50, 50, 300), np.ones(8))
    else:  # everything in one point
        made = np.ones((300, 8))
    rows = [(i, np.float32(v).tolist(), 1, 7, "x") for i, v in enumerate(made)]
    one = [1.0] * 8
    return rows + [rows[0], rows[0], (None, one, None, None, None), (None, None, None, None, None), (900, None, 1, 1, "x"), (901, [], 1, 1, "x"), (902, one[:7], 1, 1, "x"),
                   (903, one[:7] + [None], 1, 1, "x"), (904, one[:7] + [float("nan")], 1, 1, "x"), (905, one[:7] + [float("-inf")], 1, 1, "x"), (5, one, 1, 1, "x")]


@pytest.mark.parametrize("kind", ["spread", "groups", "ties", "flat", "point"])
def test_clusters_are_the_plain_ones(spark, kind):
    rows = rows_for(kind)
    found, cs = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=9, rounds=3, components=8)
    want, means = plain(rows, 9, 3, 8)
    assert sorted(map(tuple, found.collect()), key=repr) == want and cs.tolist() == means


def test_few_and_no_vectors(spark):
    rows = rows_for("spread")[:3]
    found, cs = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=9, rounds=3, components=8)
    assert sorted(r.distance for r in found.collect()) == [0, 0, 0] and len(cs) == 3
    found, cs = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and len(cs) == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    centre = rng.integers(-400, 400, (40, 10)) @ rng.integers(-9, 9, (10, 64))  # few true dimensions, as embeddings have
    v = centre[rng.integers(0, 40, 2000)] + rng.integers(-300, 300, (2000, 64))
    simplex = centroids.Simplex(centre)
    apexes, tops = simplex.of(v), simplex.of(centre)
    exact = centroids.squared(v, centre)
    inner = ((apexes[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(2)
    slack = centroids.SLACK * ((apexes**2).sum(1)[:, None] + (tops**2).sum(1)[None])
    assert (inner + (apexes[:, -1:] - tops[:, -1]) ** 2 - slack <= exact).all() and (inner + (apexes[:, -1:] + tops[:, -1]) ** 2 + slack >= exact).all()
    best, distance, work = centroids.nearest(v, apexes, centre, tops)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert work < 0.1 * exact.size  # most centroids are never compared


def test_too_large_components_are_refused():
    with pytest.raises(ValueError):
        centroids.checked(np.array([[2**27 + 1]]))
