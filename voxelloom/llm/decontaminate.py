"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is *contained* in a document when at least ``threshold`` of its
distinct shingles (five words, lower case, letters and digits only) occur in
the document.  Items are partitioned by their number of shingles; the
signature of an item is the bottom-k MinHash sketch of its shingles, k being
chosen per size class so that, by the pigeonhole principle, no document that
contains the item can avoid the whole sketch: of n shingles at most
``n - ceil(threshold * n)`` may be missing, so that one of the ``k = that + 1``
smallest hashes must be there.  A document, however long, is looked through
once against the sketches of all items; each hit is verified by exact shingle
containment on words.

The items are a query set: they are sent to the tasks in blocks of a bounded
size (``BLOCK_CHARS``), each block against all documents.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import query, table, whole_text

WORDS, THRESHOLD = 5, 0.8
BLOCK_CHARS = 16_000_000
WORD = re.compile(r"[^\W_]+")
MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], size: int = WORDS) -> list[tuple[str, ...]]:
    """Consecutive words; fewer words than ``size`` are one shingle."""
    if len(words) < size:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(size))))


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` word numbers."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ ids[i : i + n]) * MULT
        out ^= out >> np.uint64(29)
    return out


class Index:
    """Sketches of one block of items, and what their verification needs."""

    def __init__(self, items: list[tuple[int, str]], size: int = WORDS, threshold: float = THRESHOLD):
        self.size, self.threshold = size, threshold
        self.words: dict[str, int] = {}
        self.sets: dict[int, set] = {}
        sketch: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # window size -> hash -> items
        self.n: dict[int, int] = {}
        owner = defaultdict(list)
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            mine = set(shingles(words, size))
            if not mine:
                continue
            self.n[number] = len(mine)
            for s in mine:
                owner[s].append(number)
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.uint64)
            width = min(size, len(words))
            hashes = np.unique(rolling(ids, width))
            k = len(mine) - math.ceil(threshold * len(mine) - 1e-9) + 1
            # a class holds items of one power of two; its sketch is as long as its largest member needs
            for h in hashes[: max(k, self.class_length(len(mine)))]:
                sketch[width][int(h)].append(number)
        self.ids = [i for i, _ in items]
        self.owner = dict(owner)
        self.keys = {w: np.array(sorted(hs), np.uint64) for w, hs in sketch.items()}
        self.sketch = {w: dict(hs) for w, hs in sketch.items()}

    def class_length(self, n: int) -> int:
        top = 1 << max(0, (n - 1)).bit_length()
        return top - math.ceil(self.threshold * top - 1e-9) + 1

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item, shared shingles, its shingles) of the items that ``text`` contains."""
        words = words_of(text)
        ids = np.fromiter(map(self.words.get, words, [0] * len(words)), np.uint64, len(words))
        near = set()
        for width, keys in self.keys.items():
            hashes = rolling(ids, width)
            if width > 0 and len(hashes):
                known = ids > 0
                full = known[: len(hashes)].copy()
                for i in range(1, width):
                    full &= known[i : i + len(hashes)]
                hashes = hashes[full]
            if not len(hashes):
                continue
            at = np.searchsorted(keys, hashes)
            at[at == len(keys)] = 0
            for h in np.unique(hashes[keys[at] == hashes]):
                near.update(self.sketch[width][int(h)])
        if not near:
            return []
        shared = defaultdict(set)
        for width in self.keys:
            for s in set(zip(*(words[i:] for i in range(width)))):
                for number in self.owner.get(s, ()):
                    if number in near:
                        shared[number].add(s)
        return [(self.ids[i], len(s), self.n[i]) for i, s in shared.items() if len(s) >= self.threshold * self.n[i] - 1e-9]


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS):
    """The items (those with text) in lists of at most ``limit`` characters."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and held + len(r.text) > limit:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, shared, n_shingles``, a row per document row and item it contains.

    An item of fewer than five words is one shingle; items and texts without
    words match nothing.  Repeated documents and items are matched each.
    """
    schema = "doc_id long, item_id long, shared long, n_shingles long"
    out = docs.sparkSession.createDataFrame([], schema)
    base = docs.select("doc_id", whole_text().alias("_text"))
    for block in blocks(benchmark):
        index = Index(block, size, threshold)

        def look(batches, index=index):
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b["doc_id"], b["_text"]) for hit in index.search(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "shared", "n_shingles"])

        out = out.unionByName(base.mapInPandas(look, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; rows
    without text stay."""
    for block in blocks(benchmark):
        docs = docs.where(free_of(Index(block, size, threshold))(whole_text()))
    return docs


def free_of(index: Index):
    @F.pandas_udf("boolean")
    def free(text: pd.Series) -> pd.Series:
        return pd.Series([not index.search(t) for t in text], dtype=bool)

    return free


SQL = """
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
i AS (SELECT item_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS s FROM w WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM dw) WHERE s IN (SELECT s FROM i))
SELECT doc_id, item_id, count(*) AS shared, any_value(n_shingles) AS n_shingles
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9"""


@query("op4_decontaminate", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
