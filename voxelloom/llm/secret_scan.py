"""Secret scan: fixed patterns, and a likelihood ratio of two character chains.

One pass over the texts finds the spans of the fixed patterns and the
*candidates*, long runs of token characters outside those spans.  What the
patterns mark as secret are labelled samples of random strings, and all other
runs, long or short, samples of ordinary words and identifiers; the transition
counts of both are summed over the whole corpus (a fixed-size table) and give
two first-order Markov models.  A
candidate whose log-likelihood ratio passes the threshold is one more span.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import query, table, whole_text
from voxelloom.session import cut

# The patterns, their kinds in order, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KEYWORD = re.compile(r"pass(?:word|wd)|secret|token|api_?key", re.ASCII | re.IGNORECASE)
LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # greedy and leftmost: the runs of HEX that are long enough

#: A candidate has at least this many characters; shorter strings carry too little evidence.
MIN_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
N = len(ALPHABET) + 1  # and one state for the start
CODE = np.full(256, 255, np.uint8)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
#: Natural log of the odds that a candidate is an ordinary one before it is seen, and the weight of the uniform chain beside the labelled one.
LOG_ODDS, UNIFORM = 16.0, 0.5


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret itself) of the fixed patterns."""
    found = []
    if KEYWORD.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), 1, m.end(), m[0]))
    for m in LONG_HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m[0]))
    found.sort()
    return found


def candidates(text: str, spans) -> list[tuple[int, str]]:
    """Runs of token characters outside the base spans; of a run that one
    touches, the parts that are left and long enough."""
    covered: list[list[int]] = []
    for start, _, end, _ in spans:  # by start
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out, i = [], 0
    for m in RUN.finditer(text):
        at, stop = m.span()
        while i < len(covered) and covered[i][1] <= at:
            i += 1
        j = i
        while j < len(covered) and covered[j][0] < stop:
            if covered[j][0] - at >= MIN_RUN:
                out.append((at, text[at : covered[j][0]]))
            at = covered[j][1]
            j += 1
        if stop - at >= MIN_RUN:
            out.append((at, text[at:stop]))
    return out


def transitions(strings: list[str]) -> np.ndarray:
    """Pairs (previous or start, next) as flat codes, and whose they are."""
    if not strings:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    code = CODE[np.frombuffer("".join(strings).encode("ascii"), np.uint8)].astype(np.int64)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    starts = np.cumsum(size) - size
    before[starts[size > 0]] = N - 1
    return before * N + code, np.repeat(np.arange(len(strings)), size)


def corpus_pairs(texts) -> np.ndarray:
    """Transition counts of all runs of token characters in whole texts."""
    total = np.zeros(N * N, np.int64)
    for text in texts:
        code = CODE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        in_run = code != 255
        before = np.empty(len(code), np.int64)
        before[:1] = N - 1
        before[1:] = np.where(in_run[:-1], code[:-1], N - 1)
        total += np.bincount((before * N + code)[in_run], minlength=N * N)
    return total


def _scan(batches):
    for b in batches:
        rows = []
        for text in b["_text"]:
            spans = base_spans(text)
            found = candidates(text, spans)
            rows.append(([s for s, *_ in spans], [k for _, k, *_ in spans], [e for _, _, e, _ in spans], [v for *_, v in spans],
                         [s for s, _ in found], [r for _, r in found]))
        out = pd.DataFrame(rows, columns=["start", "kind", "end", "value", "at", "run"])
        out.insert(0, "doc_id", b["doc_id"].to_numpy())
        out["pairs"] = [corpus_pairs(b["_text"])] + [None] * (len(b) - 1)  # once per batch
        yield out


def _count(batches):
    total = np.zeros((2, N * N), np.int64)
    for b in batches:
        for pairs in b["pairs"]:
            if pairs is not None:
                total[0] += pairs
        pairs, _ = transitions([x for xs in b["value"] for x in xs])
        total[1] += np.bincount(pairs, minlength=N * N)
    which, pair = np.nonzero(total)
    yield pd.DataFrame({"label": which, "pair": pair, "n": total[which, pair]})


def fit(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio per transition from the counts of all (row 0) and
    random (row 1) strings; ordinary is all but the random ones."""
    counts = np.stack([np.maximum(counts[0] - counts[1], 0), counts[1]])
    table_ = counts.reshape(2, N, N)[:, :, : N - 1] + np.array([0.1, 0.0])[:, None, None]
    rows = table_.sum(2, keepdims=True)
    ordinary, labelled = table_[0] / rows[0], table_[1] / np.maximum(rows[1], 1)
    seen = rows[1] > 0
    random = np.where(seen, (1 - UNIFORM) * labelled, 0) + np.where(seen, UNIFORM, 1.0) / (N - 1)
    out = np.zeros((N, N))
    out[:, : N - 1] = np.log(random) - np.log(ordinary)
    return out.ravel()


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: per row an array of (kind, start, end) in code points
    by start, then kind; null and empty texts have none.  Repeated rows are
    scanned alike.  Without labelled secrets the random model is the uniform
    chain."""
    found = cut(docs.select("doc_id", whole_text().alias("_text")).mapInPandas(
        _scan, "doc_id long, start array<long>, kind array<int>, end array<long>, value array<string>, at array<long>, run array<string>, pairs array<long>"))
    sums = found.select("value", "pairs").mapInPandas(_count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, N * N))  # a fixed-size table, whatever the corpus
    for r in sums:
        counts[r.label, r.pair] = r.n
    ratio = fit(counts)

    def judge(batches):
        for b in batches:
            at = [x for xs in b["at"] for x in xs]
            runs = [x for xs in b["run"] for x in xs]
            pairs, owner = transitions(runs)
            score = np.bincount(owner, ratio[pairs], len(runs)) if runs else np.empty(0)
            hit, i, rows = score > LOG_ODDS, 0, []
            for start, kind, end, own in zip(b["start"], b["kind"], b["end"], b["at"]):
                spans = list(zip(start, kind, end))
                for _ in own:
                    if hit[i]:
                        spans.append((at[i], 3, at[i] + len(runs[i])))
                    i += 1
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": rows})

    return found.drop("value", "pairs").mapInPandas(judge, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")

    def joined(xs):
        return F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != "random")), 256).alias("base_sha256"), joined(spans).alias("spans"), count("random"))
