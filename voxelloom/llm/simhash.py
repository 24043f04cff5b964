"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: the direct sum of two perfect
[23, 12] codes over bits 0-22 and 23-45 of the fingerprint, each with covering
radius 3.  Every fingerprint has one home anchor, within 3 in each half, and
is replicated to every anchor within the covering radius plus the threshold:
if two fingerprints differ in at most 2 bits, ``i`` of them in the first half
and ``j`` in the second (``i + j <= 2``), the other one lies within ``3 + i``
and ``3 + j`` of the home of the first.  So each linked pair meets at the home
anchor of its smaller member, exactly once, and nothing is missed.  That makes
about 61 replicas of a *distinct* fingerprint over 2**24 anchors; copies are
folded into their fingerprint before and take no part in the comparison.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import fresh, query, salted_lookup, table, whole_text
from voxelloom.operators.components import solve_graph
from voxelloom.session import cut

SHINGLE, THRESHOLD, SEED, SALTS = 3, 2, 42, 64
BITS = 23
# Fixed value: generator polynomial of the perfect [23, 12, 7] code.
GENERATOR = 0b110001110101
CHUNK = 1 << 14


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64-bit majority of the shingles' XXH64 values, 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - size + 1)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = (ends - lens + 1)[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends)], np.uint64, n)
    count = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += np.add.reduce(bits, axis=0, dtype=np.uint16)
    on = np.packbits(2 * count > n, bitorder="little")
    return int(on.view("<i8")[0])


def remainder(word: int) -> int:
    for shift in range(BITS - 1, 10, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - 11)
    return word


class Code:
    """Error patterns of the code by syndrome: those within the covering
    radius (one each), and the shells one and two further out."""

    def __init__(self):
        unit = np.array([remainder(1 << i) for i in range(BITS)])
        self.tables = [np.zeros(256, np.int64) for _ in range(3)]
        for k, t in enumerate(self.tables):
            for bit in range(8):
                if 8 * k + bit < BITS:
                    t[np.arange(256) >> bit & 1 == 1] ^= unit[8 * k + bit]
        by_weight: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in range(6):
            sets = list(combinations(range(BITS), w))
            bits = np.array(sets, np.int64).reshape(len(sets), w)
            by_weight[w] = (1 << bits).sum(1), np.bitwise_xor.reduce(unit[bits], axis=1)
        near = [np.concatenate([by_weight[w][i] for w in range(4)]) for i in (0, 1)]
        self.shells = [self.grouped(*near), self.grouped(*by_weight[4]), self.grouped(*by_weight[5])]

    @staticmethod
    def grouped(pattern, syndrome):
        order = np.argsort(syndrome, kind="stable")
        size = np.bincount(syndrome, minlength=2048)
        return pattern[order], np.cumsum(size) - size, size

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.tables[0][x & 255] ^ self.tables[1][x >> 8 & 255] ^ self.tables[2][x >> 16]

    def words(self, x: np.ndarray, shell: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, code word) of the code words in a shell around x."""
        pattern, first, size = self.shells[shell]
        s = self.syndrome(x)
        n = size[s]
        who = np.repeat(np.arange(len(x)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
        return who, x[who] ^ pattern[at]


MASK = (1 << BITS) - 1


def anchors(code: Code, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each fingerprint, index, anchor of each replica)."""
    one, two = fp & MASK, fp >> BITS & MASK
    parts = []
    for i in range(THRESHOLD + 1):
        for j in range(THRESHOLD + 1 - i):
            who, a = code.words(one, i)
            again, b = code.words(two[who], j)
            parts.append((who[again], a[again] << BITS | b))
    home = parts[0][1]
    return home, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed), materialised."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t) for t in b["_text"]], np.int64)})

    return cut(docs.select("doc_id", whole_text().alias("_text")).mapInPandas(run, "doc_id long, fp long"))


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: each pair of different fingerprints of ``fps`` (distinct
    ``fp``) with at most two differing bits, once."""

    def spread(batches):
        code = Code()
        for b in batches:
            fp = b["fp"].to_numpy()
            for i in range(0, len(fp), CHUNK):
                part = fp[i : i + CHUNK]
                home, who, anchor = anchors(code, part)
                order = np.argsort(who, kind="stable")
                ends = np.cumsum(np.bincount(who, minlength=len(part)))[:-1]
                yield pd.DataFrame({"fp": part, "home": home, "anchors": np.split(anchor[order], ends)})

    placed = fps.mapInPandas(spread, "fp long, home long, anchors array<long>")
    home = placed.select(F.col("home").alias("anchor"), F.col("fp").alias("a"))
    copies = placed.select(F.explode("anchors").alias("anchor"), F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)
    return home.join(copies, "anchor").where(near).select("a", "b")


def near_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``doc_id, fp, component_id``: one row per input row.

    ``component_id`` is the smallest doc_id that links reach.  Texts without
    words have fingerprint zero and are linked like any other; a null doc_id
    counts for nothing in the smallest id.  Repeated rows give repeated rows.
    """
    own = fingerprints(docs)
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = solve_graph(links(fps.select("fp")), []).select(F.col("node").alias("fp"), "root").distinct()
    placed = fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = cut(placed)
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_lookup(placed.withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(salts))), component, "root", "_salt").select("fp", "component_id")
    rows = own.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    return salted_lookup(rows, named, "fp", "_salt").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component,
    with all their columns; rows without a doc_id stay."""
    (id_,) = fresh(docs, "_lost")
    lost = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(lost, F.col("doc_id") == F.col(id_), "left_anti")


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
