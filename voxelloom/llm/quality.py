"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a row of shape features in one pass.  The model is fitted in
numpy on a bounded sample of labelled rows (``MAX_ROWS``): features are binned,
shallow trees of at most four leaves are boosted on one feature after the
other, round by round, and summed into one lookup table per feature; then the
same is done for the pairs of features that still explain most.  A score is
the sum of table entries, through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import fold_of, query, table, whole_text
from voxelloom.session import cut

#: Expected number of labelled rows that the model is fitted on, at most.
MAX_ROWS = 40_000
FOLDS, CUTOFF = 5, 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 48, 12, 8, 160, 0.1

CLASSES = ("upper", "lower", "digit", "blank", "stop", "mark", "symbol", "other")
CLASS_OF = np.full(256, 7, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", ".?;:", ",-'\"()", "!#$%&*+/<=>@[\\]^_`{|}~")):
    CLASS_OF[np.frombuffer(_chars.encode(), np.uint8)] = _k
NAMES = ("log_words", "word_chars", "upper", "digits", "blanks", "stops", "marks", "symbols", "other_bytes", "distinct_words", "top_word",
         "repeated_next", "distinct_pairs", "repeated_lines", "log_lines", "words_per_line")


def features(text: str) -> list[float]:
    """Shape of a whole text; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(CLASS_OF[data], minlength=8) / len(data)
    counts = Counter(words)
    pairs = list(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    return [np.log1p(n), sum(map(len, words)) / n, share[0], share[2], share[3], share[4], share[5], share[6], share[7],
            len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(1, n - 1),
            1 - len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines)]


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.full(len(x), self.base)
        for f, (edge, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edge, x[:, f], side="right")]
        for (f, g), values in zip(self.pairs, self.pair_tables):
            out += values[np.searchsorted(self.pair_edges[f], x[:, f], side="right"), np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def leaf(g, h):
    return g / (h + 1.0)


def gain(g, h):
    return g * g / (h + 1.0)


def split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best cut of binned gradients: bins below it go left, 0 for none."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    value = gain(gl, hl) + gain(g.sum() - gl, h.sum() - hl) - gain(g.sum(), h.sum())
    value[(hl < 1) | (h.sum() - hl < 1)] = 0
    k = int(np.argmax(value))
    return (k + 1, float(value[k])) if value[k] > 1e-9 else (0, 0.0)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of depth two."""
    out = np.zeros(len(g))
    k, _ = split(g, h)
    for a, b in ((0, k), (k, len(g))) if k else ((0, len(g)),):
        m = a + split(g[a:b], h[a:b])[0]
        for i, j in ((a, m), (m, b)) if m > a else ((a, b),):
            out[i:j] = leaf(g[i:j].sum(), h[i:j].sum())
    return out


def tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same on a grid: one cut along one axis, then one along the other on each side."""
    best = None
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        k = split(a.sum(1), b.sum(1))[0]
        out = np.zeros_like(a)
        value = 0.0
        for lo, hi in ((0, k), (k, len(a))) if k else ((0, len(a)),):
            gs, hs = a[lo:hi].sum(0), b[lo:hi].sum(0)
            m = split(gs, hs)[0]
            for i, j in ((0, m), (m, len(gs))) if m else ((0, len(gs)),):
                out[lo:hi, i:j] = leaf(gs[i:j].sum(), hs[i:j].sum())
                value += gain(gs[i:j].sum(), hs[i:j].sum())
        if best is None or value > best[0]:
            best = value, out.T if flip else out
    return best[1]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Model of the rows ``x`` with labels ``y``; a single class or no rows
    give its smoothed share for every text."""
    n, width = len(y), len(NAMES)
    x = x.reshape(n, width)
    share = (y.sum() + 1) / (n + 2)
    edges = [cuts(x[:, f], BINS) for f in range(width)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], base=float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    out = np.full(n, model.base)

    def boost(index, values, shape, grow):
        p = 1 / (1 + np.exp(-out))
        size = int(np.prod(shape))
        g = np.bincount(index, y - p, size).reshape(shape)
        h = np.bincount(index, p * (1 - p), size).reshape(shape)
        step = RATE * grow(g, h)
        values += step
        out[:] = np.clip(out + step.ravel()[index], -30, 30)

    for _ in range(ROUNDS):
        for f in range(width):
            boost(bins[f], model.tables[f], model.tables[f].shape, tree)
    coarse = [cuts(x[:, f], PAIR_BINS) for f in range(width)]
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-out))
    rank = []
    for f in range(width):
        for k in range(f):
            shape = (len(coarse[f]) + 1, len(coarse[k]) + 1)
            cell = low[f] * shape[1] + low[k]
            g, h = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
            rank.append((float(gain(g, h).sum()), f, k))
    model.pair_edges = coarse
    for _, f, k in sorted(rank, reverse=True)[:PAIRS]:
        model.pairs.append((f, k))
        model.pair_tables.append(np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1)))
    for _ in range(ROUNDS // 2):
        for (f, k), values in zip(model.pairs, model.pair_tables):
            boost(low[f] * values.shape[1] + low[k], values, values.shape, tree2)
    return model


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, features``: one row per input row; null text counts as empty."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "features": [features(t) for t in b["_text"]]})

    return docs.select("doc_id", whole_text().alias("_text")).mapInPandas(run, "doc_id long, features array<double>")


def train(measured: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the measured rows that have a label; null labels are left out,
    and above ``max_rows`` a hash of the id picks a share of them."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    rows = measured.join(known, "doc_id").orderBy("doc_id", "_label", "features").toPandas()
    return fit(np.array(rows["features"].tolist(), float).reshape(-1, len(NAMES)), rows["_label"].to_numpy(float))


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of measured rows."""

    def run(batches):
        for b in batches:
            x = np.array(b["features"].tolist(), float).reshape(-1, len(NAMES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(x)})

    return measured.mapInPandas(run, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score at least ``cutoff``, with all their
    columns, after a fit on those of them that are labelled."""
    model = train(measure(docs), labels)  # rows of features are joined, not texts

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text], float).reshape(-1, len(NAMES))
        return pd.Series(model.score(x))

    return docs.where(rate(whole_text()) >= cutoff)


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(measure(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), FOLDS) != 0)
    scored = score(measured, train(measured, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= CUTOFF, 1).otherwise(0).cast("int").alias("predicted"))
