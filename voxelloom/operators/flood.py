"""Seeded watershed as a minimax forest, solved on a graph of block-local basins.

Voxels are ordered by height, then by distance to the nearest seed, then by
coordinate.  An edge between face neighbours is as dear as its later voxel,
ties by its earlier one, so no two edges are equal and the cheapest forest that
hangs every voxel on a seed is unique: it does not depend on blocks or tasks,
and flooding voxel by voxel from the seeds gives the same labels.  The distance
in the order makes floods that meet on a plateau meet half way.

Each block joins its voxels along cheapest outgoing edges (a cheapest outgoing
edge is always in the forest) until every basin's cheapest edge leaves the
block.  Only basins, their edges and the voxels on block faces go on; the graph
at least halves in every Borůvka round, whatever the size of a basin.  Voxels
are written twice: with their basin, and with their label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.blocks import AXES, BLOCK, map_blocks
from voxelloom.operators.components import BITS, pack
from voxelloom.operators.envelope import nearest_site
from voxelloom.operators.joins import join_small
from voxelloom.session import cut

VOXEL = ["volume_id", "z", "y", "x"]
#: A graph this small is finished on the driver (some megabytes); larger ones go on in rounds.
FEW = 50_000
VOXEL_ROW, BASIN_ROW, INNER_EDGE, OUTER_EDGE = range(4)
COST = ["h1", "d1", "p1", "h2", "d2", "p2"]  # of the later voxel, then of the earlier one
_SCHEMA = "kind int, z long, y long, x long, a long, b long, h1 double, d1 double, p1 long, h2 double, d2 double, p2 long"


def packed(flat: np.ndarray, shape, origin) -> np.ndarray:
    z, y, x = (c + o for c, o in zip(np.unravel_index(flat, shape), origin))
    if len(flat) and (max(z.max(), y.max(), x.max()) >= 1 << BITS or min(z.min(), y.min(), x.min()) < 0):
        raise ValueError("coordinate beyond the packed range")
    return (z << 2 * BITS) + (y << BITS) + x


def roots_of(up: np.ndarray) -> np.ndarray:
    """Ends of the pointer chains; of two that point at each other the smaller is the end."""
    mutual = (up[up] == np.arange(len(up))) & (np.arange(len(up)) < up)
    up = np.where(mutual, np.arange(len(up)), up)
    while True:
        far = up[up]
        if np.array_equal(far, up):
            return up
        up = far


def join_inside(cost: np.ndarray, u: np.ndarray, v: np.ndarray, fixed: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Basin (a voxel index) of every voxel: basins follow their cheapest
    outgoing edge until it leads outside or they are ``fixed`` (seeded).

    ``cost``: rank of each edge ``u, v``; edges come cheapest first.
    """
    n = len(fixed)
    basin = np.arange(n)
    settled = fixed | outside
    while True:
        a, b = basin[u], basin[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        first = np.full(n, len(a))
        for side in (a, b):
            rev = np.arange(len(side))[::-1]
            mine = np.full(n, len(side))
            mine[side[rev]] = rev  # of equal indices the last assignment, the cheapest edge, stays
            first = np.minimum(first, mine)
        go = np.flatnonzero((first < len(a)) & ~settled & (basin == np.arange(n)))
        target = np.where(a[first[go]] == go, b[first[go]], a[first[go]])
        inside = ~outside[target]
        go, target = go[inside], target[inside]
        if not len(go):
            return basin
        up = np.arange(n)
        up[go] = target
        root = roots_of(up)
        basin = root[basin]


def block_basins(arrays, origin, inner, meta) -> dict[str, np.ndarray]:
    """Rows of one block: its voxels with their basin, its basins, and the
    cheapest edges between basins and to voxels of other blocks."""
    h, d, seed = (arrays[c].ravel() for c in ("height", "far", "seed"))
    shape = arrays["height"].shape
    there = np.isfinite(h)
    own = np.zeros(shape, bool)
    own[inner] = True
    own = own.ravel() & there
    voxels = np.flatnonzero(there)
    rank = np.zeros(len(h), np.int64)
    rank[voxels[np.lexsort((voxels, d[voxels], h[voxels]))]] = np.arange(len(voxels))  # flat order is coordinate order
    flat = np.arange(len(h)).reshape(shape)
    ends = []
    for axis in range(3):
        one, two = (np.moveaxis(flat, axis, 0)[s].ravel() for s in (slice(None, -1), slice(1, None)))
        good = there[one] & there[two] & (own[one] | own[two])
        ends.append((one[good], two[good]))
    u, v = (np.concatenate(e) for e in zip(*ends))
    later, earlier = np.maximum(rank[u], rank[v]), np.minimum(rank[u], rank[v])
    cheap = np.lexsort((earlier, later))
    u, v = u[cheap], v[cheap]
    fixed, outside = (seed > 0) & own, ~own
    basin = join_inside(cheap, u, v, fixed, outside)
    at = np.flatnonzero(own)
    name = np.zeros(len(h), np.int64)
    name[voxels] = packed(voxels, shape, origin)
    seeded = seed[basin] > 0
    rows = [frame(VOXEL_ROW, len(at), a=name[basin[at]], **{c: x + o for c, x, o in zip(AXES, np.unravel_index(at, shape), origin)})]
    heads = np.unique(basin[at])
    rows.append(frame(BASIN_ROW, len(heads), a=name[heads], b=np.where(own[heads], seed[heads], 0)))
    for one, two in ((u, v), (v, u)):  # directed: every open basin keeps its own cheapest edges
        use = own[one] & ~seeded[basin[one]] & (basin[one] != basin[two])
        x, y = one[use], two[use]
        goal = np.where(own[y], basin[y], y)
        _, first = np.unique(basin[x] * len(h) + goal, return_index=True)
        x, y, goal = x[first], y[first], goal[first]
        top, low = np.where(rank[x] > rank[y], x, y), np.where(rank[x] > rank[y], y, x)
        kind = np.where(own[y], INNER_EDGE, OUTER_EDGE)
        rows.append(frame(kind, len(x), a=name[basin[x]], b=name[goal], h1=h[top], d1=d[top], p1=name[top], h2=h[low], d2=d[low], p2=name[low]))
    return {c: np.concatenate([r[c] for r in rows]) for c in rows[0]}


def frame(kind, n: int, **given) -> dict[str, np.ndarray]:
    zero = {"h1": 0.0, "d1": 0.0, "h2": 0.0, "d2": 0.0}
    out = {"kind": np.broadcast_to(np.asarray(kind, np.int32), n)}
    for c in (*AXES, "a", "b", *COST):
        out[c] = given[c] if c in given else np.full(n, zero.get(c, 0))
    return out


def follow(up: DataFrame) -> DataFrame:
    """``volume_id, node, root``: ends of the chains of ``node -> up``; what has no row is an end.
    Chains are shortened by half in every round."""
    while True:
        next_ = up.select("volume_id", F.col("node").alias("up"), F.col("up").alias("_far"))
        joined = cut(up.join(next_, ["volume_id", "up"], "left"))
        up = joined.select("volume_id", "node", F.coalesce("_far", "up").alias("up"))
        if joined.where(F.col("_far").isNotNull()).isEmpty():
            return up.withColumnRenamed("up", "root")


def finish(node: DataFrame, edges: DataFrame) -> DataFrame:
    """The rest of the forest for at most ``FEW`` edges: cheapest first, parts
    with two different seeds are never joined.  ``volume_id, root, label``."""
    labels = node.where(F.col("label") > 0).select("volume_id", F.col("root").alias("b"), "label").distinct()
    rows = edges.join(labels, ["volume_id", "b"], "left").select("volume_id", "a", "b", F.coalesce("label", F.lit(0)).alias("label"), "cost.*").toPandas()
    rows = rows.sort_values(COST, kind="stable")
    up: dict[tuple, tuple] = {}
    name: dict[tuple, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for v, b, label in rows[["volume_id", "b", "label"]].itertuples(index=False):
        if label:
            name[v, b] = label
    for v, a, b in rows[["volume_id", "a", "b"]].itertuples(index=False):
        x, y = root((v, a)), root((v, b))
        if x != y and not (name.get(x) and name.get(y)):
            up[x] = y
            name[y] = name.get(x) or name.get(y) or 0
    found = [(int(x[0]), int(x[1]), int(name.get(root(x), 0))) for x in list(up)]
    return node.sparkSession.createDataFrame(found, "volume_id long, root long, _label long")


def forest(basins: DataFrame, edges: DataFrame, few: int = FEW) -> DataFrame:
    """``volume_id, a, label`` of the basins that a seed reaches, by Borůvka
    rounds; a graph of at most ``few`` edges is finished at once.

    ``basins``: ``volume_id, a, label`` (0 for none).  ``edges``: directed,
    ``volume_id, a, b, cost`` from every basin without a label.
    """
    node = cut(basins.select("volume_id", "a", F.col("a").alias("root"), "label"))
    edges = cut(edges)
    while not edges.isEmpty():
        if edges.limit(few + 1).count() <= few:
            node = node.join(finish(node, edges), ["volume_id", "root"], "left").select(
                "volume_id", "a", "root", F.greatest("label", F.coalesce("_label", F.lit(0))).alias("label"))
            break
        best = edges.groupBy("volume_id", "a").agg(F.min(F.struct("cost", "b")).alias("_e"))
        up = cut(best.select("volume_id", F.col("a").alias("node"), F.col("_e.b").alias("up")))
        back = up.select("volume_id", F.col("node").alias("up"), F.col("up").alias("node"), F.lit(True).alias("_back"))
        up = up.join(back, ["volume_id", "node", "up"], "left").where(F.col("_back").isNull() | (F.col("node") > F.col("up"))).drop("_back")
        root = cut(follow(up))
        labels = node.where(F.col("label") > 0).select("volume_id", F.col("root").alias("_to"), F.col("label").alias("_label")).distinct()
        moved = root.join(labels.withColumnRenamed("_to", "root"), ["volume_id", "root"], "left").select(
            "volume_id", "node", F.col("root").alias("_root"), "_label")
        node = cut(node.join(moved.withColumnRenamed("node", "root"), ["volume_id", "root"], "left").select(
            "volume_id", "a", F.coalesce("_root", "root").alias("root"), F.greatest("label", F.coalesce("_label", F.lit(0))).alias("label")))
        left = edges.join(moved.select("volume_id", F.col("node").alias("a"), F.col("_root").alias("_a"), F.col("_label").alias("_done")), ["volume_id", "a"], "left")
        left = left.where(F.col("_done").isNull()).join(moved.select("volume_id", F.col("node").alias("b"), F.col("_root").alias("_b")), ["volume_id", "b"], "left")
        left = left.select("volume_id", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "cost").where("a <> b")
        edges = cut(left.groupBy("volume_id", "a", "b").agg(F.min("cost").alias("cost")))
    return node.where(F.col("label") > 0).select("volume_id", "a", "label")


def watershed(height: DataFrame, seeds: DataFrame, block=BLOCK, few: int = FEW) -> DataFrame:
    """``volume_id, z, y, x, label`` for the mask voxels a seed can reach.

    ``height``: mask voxels with ``height``.  ``seeds``: voxels with ``label``;
    those outside the mask do not count.
    """
    found = seeds.select(*VOXEL, F.col("label").alias("seed"))
    mask = cut(height.select(*VOXEL, "height").join(found, VOXEL, "left").withColumn("seed", F.coalesce("seed", F.lit(0))))
    ends = [f"{a}1" for a in AXES]
    box = mask.groupBy("volume_id").agg(*[(F.max(a) + 1).alias(e) for a, e in zip(AXES, ends)])
    away = nearest_site(mask, mask.where("seed > 0").select(*VOXEL), carry=["height", "seed"])
    start = away.select(*VOXEL, "height", "seed", F.coalesce("dist", F.lit(0.0)).alias("far"))
    columns = {"height": (np.float64, np.inf), "far": (np.float64, 0.0), "seed": (np.int64, 0)}
    start = join_small(start, box, ["volume_id"])
    made = cut(map_blocks(start, block_basins, _SCHEMA, columns, block, lo=(1, 1, 1), hi=(1, 1, 1), meta=ends, core_only=True, inside=True))
    voxels = made.where(F.col("kind") == VOXEL_ROW).select(*VOXEL, "a")
    basins = made.where(F.col("kind") == BASIN_ROW).select("volume_id", "a", F.col("b").alias("label"))
    cost = F.struct(*COST).alias("cost")
    inner = made.where(F.col("kind") == INNER_EDGE).select("volume_id", "a", "b", cost)
    outer = made.where(F.col("kind") == OUTER_EDGE).select("volume_id", "a", F.col("b").alias("_p"), cost)
    # the basin of a voxel behind a face is known to its own block
    edge = F.lit(False)
    for a, b in zip(AXES, block):
        edge = edge | (F.pmod(a, F.lit(b)) == 0) | (F.pmod(a, F.lit(b)) == b - 1)
    faces = voxels.where(edge).select("volume_id", pack(F.col("z"), F.col("y"), F.col("x")).alias("_p"), F.col("a").alias("b"))
    edges = inner.unionByName(outer.join(faces, ["volume_id", "_p"]).drop("_p")).groupBy("volume_id", "a", "b").agg(F.min("cost").alias("cost"))
    return join_small(voxels, forest(basins, edges, few), ["volume_id", "a"]).select(*VOXEL, "label")
