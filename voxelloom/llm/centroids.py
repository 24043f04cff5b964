"""Centroid clustering of integer vectors, with centroids filtered by n-simplex
projection.

A few pivots are chosen among the starting centroids and span a simplex.  The
distances of a vector to the pivots, kept for all rounds, place it as the apex
over that base: its coordinates in the pivots' span and its altitude above it.
Between two apexes the plain Euclidean distance is never more, and with one
altitude turned downwards never less, than the distance of the vectors.  So
per round a vector meets all centroids only in the few apex coordinates; those
whose lower bound exceeds the smallest upper bound are out, and the rest are
compared in exact integers.

Centroids (``k`` rows) are on the driver; vectors never are.  Every task sums
its own vectors per cluster before anything is shuffled, so a cluster that
holds most vectors is no hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import query, table
from voxelloom.session import cut

K, ROUNDS, COMPONENTS, SCALE, PREFIX = 40, 5, 64, 256, "2:"
PIVOTS = 16
#: Components beyond this are refused: squared distances stay below 2**63.
LIMIT = 2**27
#: Pivots this flat over the others, as a share of the widest distance, are not taken.
FLAT = 1e-3
#: Slack of the bounds against rounding, as a share of the squared distances to the first pivot.
SLACK = 1e-9
STEP = 4096  # vectors at a time


def kept(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, _v``: the vectors of the wanted length without null or
    non-finite components, as integers."""
    whole = (F.size("embedding") == components) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(whole).select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("_v"))


def checked(v: np.ndarray) -> np.ndarray:
    if v.size and max(int(v.max()), -int(v.min())) > LIMIT:
        raise ValueError(f"components beyond {LIMIT} have no exact distance in 64 bits")
    return v


def start(vectors: DataFrame, k: int = K, prefix: str = PREFIX) -> np.ndarray:
    """The ``k`` first vectors by the hash of their id, ties by components."""
    name = F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name.cast("binary"), 256), "_v").limit(k).collect()
    return checked(np.array([r._v for r in rows], np.int64))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b``."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, row in enumerate(b):
        d = a - row
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Simplex:
    """The base spanned by pivots taken greedily, the highest over the others first."""

    def __init__(self, candidates: np.ndarray, pivots: int = PIVOTS):
        chosen, self.base = [0], np.zeros((0, 0))
        far = squared(candidates, candidates).astype(float)
        least = FLAT * FLAT * far.max()
        while len(chosen) < min(pivots, len(candidates)):
            self.pivots = candidates[chosen]
            height = self.apex(far[:, chosen])[:, -1] ** 2
            top = int(height.argmax())
            if height[top] <= least:
                break
            row = self.apex(far[[top]][:, chosen])[0]
            grown = np.zeros((len(chosen), len(chosen)))
            grown[:-1, :-1], grown[-1] = self.base, row
            self.base = grown
            chosen.append(top)
        self.pivots = candidates[chosen]

    def apex(self, d: np.ndarray) -> np.ndarray:
        """Coordinates of vectors with squared pivot distances ``d``, altitude last."""
        first = d[:, :1].astype(float)
        right = (first + (self.base**2).sum(1) - d[:, 1:]) / 2
        inner = np.linalg.solve(self.base, right.T).T if len(self.base) else right
        height = np.sqrt(np.maximum(0, first[:, 0] - (inner**2).sum(1)))
        return np.column_stack([inner, height])

    def of(self, v: np.ndarray) -> np.ndarray:
        return self.apex(squared(v, self.pivots))


def nearest(v: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared
    distance, and how many exact distances that took."""
    inner = (apexes[:, None, :-1] - tops[None, :, :-1]) ** 2
    inner = inner.sum(2)
    a, b = apexes[:, -1:], tops[:, -1][None]
    slack = SLACK * ((apexes**2).sum(1)[:, None] + (tops**2).sum(1)[None])
    lower, upper = inner + (a - b) ** 2 - slack, inner + (a + b) ** 2 + slack
    rows, columns = np.nonzero(lower <= upper.min(1)[:, None])
    exact = np.full(inner.shape, np.iinfo(np.int64).max)
    for i in range(0, len(rows), 16 * STEP):
        r, c = rows[i : i + 16 * STEP], columns[i : i + 16 * STEP]
        d = v[r] - centroids[c]
        exact[r, c] = np.einsum("ij,ij->i", d, d)
    best = exact.argmin(1)
    return best, exact[np.arange(len(v)), best], len(rows)


def matrix(column, dtype) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(dtype).reshape(len(column), -1)


def listed(m: np.ndarray) -> pa.Array:
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))


def projected(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """``vec_id, _v, _apex`` of every vector, materialised for all rounds."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                v = checked(matrix(part.column("_v"), np.int64))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), listed(v.astype(np.int32)), listed(simplex.of(v))], ["vec_id", "_v", "_apex"])

    return cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "_v").mapInArrow(run, "vec_id long, _v array<int>, _apex array<double>"))


def sums(made: DataFrame, centroids: np.ndarray, simplex: Simplex) -> dict[int, tuple[int, list[int]]]:
    """Per cluster with vectors: their number and componentwise exact sums."""
    tops, width = simplex.of(centroids), centroids.shape[1]

    def run(batches):
        total = np.zeros((len(centroids), width + 1), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                v = matrix(part.column("_v"), np.int64)
                best, _, _ = nearest(v, matrix(part.column("_apex"), float), centroids, tops)
                np.add.at(total, best, np.column_stack([v, np.ones(len(v), np.int64)]))
        some = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(some), listed(total[some])], ["_c", "_sum"])

    parts = made.select("_v", "_apex").mapInArrow(run, "_c long, _sum array<long>").select("_c", F.posexplode("_sum").alias("_i", "_x"))
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("_c", "_i").agg(F.sum(F.col("_x").cast("decimal(38,0)")).alias("_x")).collect():  # k rows of width + 1
        found.setdefault(r._c, [0] * (width + 1))[r._i] = int(r._x)
    return {c: (row[-1], row[:-1]) for c, row in found.items()}


def assigned(made: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector, materialised."""
    tops = simplex.of(centroids)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                best, distance, _ = nearest(matrix(part.column("_v"), np.int64), matrix(part.column("_apex"), float), centroids, tops)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return cut(made.mapInArrow(run, "vec_id long, cluster int, distance long"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, prefix: str = PREFIX, components: int = COMPONENTS) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, cluster, distance`` per kept vector, final centroids).

    Vectors that are null, of another length or with null or non-finite
    components are left out; a null vec_id counts as the empty text where the
    start is chosen; repeated rows are vectors of their own, also as centroids;
    fewer than ``k`` vectors start as many centroids; an empty table gives none.
    """
    some = kept(vectors, components)
    centroids = start(some, k, prefix)
    if not len(centroids):
        return some.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    simplex = Simplex(centroids)
    made = projected(some, simplex)
    for _ in range(rounds):
        for c, (n, total) in sums(made, centroids, simplex).items():
            centroids[c] = [x // n for x in total]
    return assigned(made, centroids, simplex), centroids


def exact_clusters_sql(k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS) -> str:
    distance = "list_sum(list_transform(list_zip(a.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {components}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{PREFIX}' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT a.rid, c.c, CAST({distance} AS BIGINT) AS d FROM kept a, c{r} c
  QUALIFY row_number() OVER (PARTITION BY a.rid ORDER BY d, c.c) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN
  (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM
    (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS i FROM a{r} a JOIN kept k USING (rid)) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return ",\n".join(steps) + f"""
SELECT k.vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (rid) JOIN c{rounds} c ON c.c = a.c"""


@query("op11_simplex_clusters", exact_clusters_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    parts = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    every = sum(parts.values())
    known = [(c, parts.get(c, 0), every, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
