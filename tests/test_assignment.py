import itertools
import random

import pytest
from pyspark.sql import functions as F

from voxelloom.operators.assignment import assign, best_matching
from voxelloom.operators.evaluate import instance_scores
from voxelloom.operators.labels import overlaps_of


def brute(edges):
    """(number, total score) of the best matching of ``{(a, b): score}``, by trying all."""
    best = (0, 0.0)
    left = sorted({a for a, _ in edges})
    for choice in itertools.product(*[[None, *[b for x, b in edges if x == a]] for a in left]):
        used = [b for b in choice if b is not None]
        if len(used) == len(set(used)):
            best = max(best, (len(used), sum(edges[a, b] for a, b in zip(left, choice) if b is not None)))
    return best


def random_edges(rng, n, m, share):
    return {(a, b): rng.choice([0.25, 0.5, rng.random()]) for a in range(n) for b in range(m) if rng.random() < share}


def worth(edges, chosen):
    assert len({a for a, _ in chosen}) == len({b for _, b in chosen}) == len(chosen)
    return len(chosen), sum(edges[p] for p in chosen)


@pytest.mark.parametrize("seed", range(60))
def test_assignment_is_the_best(seed):
    rng = random.Random(seed)
    edges = random_edges(rng, rng.randint(1, 6), rng.randint(1, 6), rng.choice([0.3, 0.6, 1.0]))
    pairs = list(edges)
    got = worth(edges, [pairs[i] for i in assign(pairs, list(edges.values()))])
    number, total = brute(edges)
    assert got[0] == number and got[1] == pytest.approx(total)
    again = rng.sample(pairs, len(pairs))  # the order of rows does not matter
    assert {again[i] for i in assign(again, [edges[p] for p in again])} == {pairs[i] for i in assign(pairs, list(edges.values()))}


def test_long_chain():
    n = 20_000  # a chain whose best pairs in the middle leave both its ends alone
    edges = {(i, i): 0.34 for i in range(n)} | {(i, i - 1): 0.4 for i in range(1, n)}
    assert len(assign(list(edges), list(edges.values()))) == n


def test_groups_of_a_table(spark):
    rng = random.Random(7)
    tables = {v: random_edges(rng, 5, 5, 0.35) for v in range(4)} | {9: {(2**62 + 5, 2**62 + 5): 0.4, (2**62 + 5, 1): 0.4}}
    rows = [(v, a, b, s, "x") for v, edges in tables.items() for (a, b), s in edges.items()]
    pairs = spark.createDataFrame(rows, "volume_id long, gt long, pred long, iou double, root string")
    got = {}
    for r in best_matching(pairs, "gt", "pred", ["volume_id"]).collect():
        got.setdefault(r.volume_id, []).append((r.gt, r.pred))
    for v, edges in tables.items():
        number, total = worth(edges, got.get(v, []))
        assert (number, pytest.approx(total)) == brute(edges)
    assert best_matching(pairs.limit(0), "gt", "pred", ["volume_id"]).count() == 0
    with pytest.raises(ValueError, match="beyond"):
        best_matching(pairs, "gt", "pred", ["volume_id"], limit=1)


def test_greedy_choice_would_lose_a_pair(spark):
    # the best pair (1, 2) would leave both 1 and 2 of the other side without a partner
    counts = {(1, 1): 6, (1, 2): 8, (2, 2): 6}
    rows = [(0, g, p) for (g, p), n in counts.items() for _ in range(n)]
    vox = spark.createDataFrame(rows, "volume_id long, gt long, pred long")
    table = vox.groupBy("volume_id", "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    assert {(r.gt, r.pred): round(r.iou, 3) for r in overlaps_of(table, "gt", "pred").collect()} == {(1, 1): 0.429, (1, 2): 0.4, (2, 2): 0.429}
    assert instance_scores(vox, "gt", "pred", ["volume_id"], 0.4).first().tp == 2
    more = vox.unionByName(spark.createDataFrame([(0, 1, 2)] * 4, vox.schema))  # now (1, 2) is the best of the three
    assert instance_scores(more, "gt", "pred", ["volume_id"], 0.3).first().tp == 2
