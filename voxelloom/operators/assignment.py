"""Best one-to-one matching of overlapping objects.

Of the candidate pairs the largest possible number is matched, and among those
matchings one of the largest total IoU.  Candidates split into connected groups
that don't influence each other: pairs without a rival are matched at once, the
rest is solved group by group.  A pair with IoU of ``t`` or more holds at least the
share ``t`` of either object, so an object has at most ``1 / t`` candidates, and groups
are chains and small clusters; one of more than ``LIMIT`` pairs fails.
"""

from __future__ import annotations

import heapq
import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.components import solve_graph
from voxelloom.session import cut

LIMIT = 100_000
SCALE = 1 << 40  # IoU is compared as a whole number of these parts


def assign(pairs: list[tuple], scores: list[float]) -> list[int]:
    """Positions of the pairs ``(a, b)`` that are matched, ascending.

    Shortest augmenting paths: each ``a`` also has a partner of its own that
    costs more than all real ones together, so that as few as possible take it.
    Equal pairs count once; the result depends on the set of pairs only.
    """
    links: dict = {}
    for i, ((a, b), score) in enumerate(zip(pairs, scores)):
        links.setdefault(a, {})[b] = (round((1 - score) * SCALE), i)
    rank = {b: j for j, b in enumerate(sorted({b for _, b in pairs}))}
    left = sorted(links)
    random.Random(1).shuffle(left)  # along a chain, searches in ascending order would run back over all of it
    alone = SCALE * (len(left) + 1)
    options = [[(rank[b], *link) for b, link in sorted(links[a].items())] + [(len(rank) + i, alone, None)] for i, a in enumerate(left)]
    price: dict[int, int] = {}
    owner: dict[int, int] = {}
    taken: list = [None] * len(left)  # the option of each left object
    for start in range(len(left)):
        cost: dict[int, int] = {}
        via: dict[int, tuple] = {}
        done, heap, i, base = set(), [], start, 0
        while True:
            for option in options[i]:
                j, c = option[0], option[1]
                d = base + c - price.get(j, 0)
                if j not in done and d < cost.get(j, math.inf):
                    cost[j], via[j] = d, (i, option)
                    heapq.heappush(heap, (d, j))
            d, j = heapq.heappop(heap)
            while j in done or d > cost[j]:
                d, j = heapq.heappop(heap)
            if j not in owner:
                break
            done.add(j)
            i = owner[j]
            base = d - (taken[i][1] - price.get(j, 0))
        for k in done:
            price[k] = price.get(k, 0) + cost[k] - d
        while True:
            i, option = via[j]
            old, taken[i], owner[j] = taken[i], option, i
            if i == start:
                break
            j = old[0]
    return sorted(o[2] for o in taken if o[2] is not None)


def best_matching(pairs: DataFrame, a: str, b: str, keys: list[str], score: str = "iou", limit: int = LIMIT) -> DataFrame:
    """``keys, a, b`` of the matched pairs of the candidates ``pairs``, one row per
    pair, matched within ``keys``.  Ids and keys are not null; no candidates give no rows."""
    some = cut(pairs.select(*keys, a, b, score))
    rivals_a = some.groupBy(*keys, a).agg(F.count(F.lit(1)).alias("_na"))
    rivals_b = some.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_nb"))
    seen = cut(some.join(rivals_a, keys + [a]).join(rivals_b, keys + [b]))
    free = (F.col("_na") == 1) & (F.col("_nb") == 1)
    node_a, node_b = (F.struct(F.lit(side).alias("side"), F.col(c).cast("long").alias("id")) for side, c in enumerate((a, b)))
    rest = seen.where(~free)
    roots = solve_graph(rest.select(*keys, node_a.alias("a"), node_b.alias("b")), keys)
    grouped = cut(rest.select(*keys, a, b, score, node_a.alias("node")).join(roots, keys + ["node"]).drop("node"))
    large = grouped.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n
    if (large or 0) > limit:
        raise ValueError(f"a group of {large} candidate pairs is beyond {limit}: raise the threshold or the limit")
    chosen = pairs.select(*keys, a, b).schema

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[assign(list(zip(frame[a], frame[b])), frame[score].tolist())][[*keys, a, b]]

    solved = grouped.groupBy(*keys, "root").applyInPandas(solve, chosen)
    return seen.where(free).select(*keys, a, b).unionByName(solved)
