"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both tokenizers cut a text into tokens with byte ends.  Where the same number
of tokens lies on both sides of a stretch, its ends lie on one diagonal of the
two end arrays: equal at a constant index shift.  From a place where both agree
the stretch is probed at that shift with doubling widths, so a long one-to-one
run costs few comparisons; where a probe fails it is halved down to the first
difference.  The irregular group there is walked token by token until the ends
meet again, the shift is updated, and the next stretch is probed.

Every document writes its distinct linked id pairs once, into the shared
folder.  Pairs are counted over the corpus with map-side combining; the count
table is met by broadcast up to a measured size and by a join beyond it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import query, table, whole_text
from voxelloom.llm.packing import Encoder, byte_of_character
from voxelloom.operators.joins import join_small
from voxelloom.session import shared_dir

STEP = 256  # documents encoded at a time
#: Groups with more token pairs than this are written by distinct ids of each side.
WIDE = 4096
START = 4  # tokens of the first probe of a run
SHIFT = 32  # a pair is one number: the id of the first tokenizer above that of the second


class Side:
    """Ids of texts by one tokenizer, and the bytes each id stands for."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.width = np.array([len(t) for t in tokens], np.int64)
        self._spelled: np.ndarray | None = None

    def spelled(self, last: bytes) -> np.ndarray:
        """Every id in digits with a comma, then every id with the mark ``last``."""
        if self._spelled is None:
            self._spelled = np.array([b"%d" % i + mark for mark in (b",", last) for i in range(len(self.tokens))], object)
        return self._spelled

    @classmethod
    def byte_level(cls, path: str) -> Side:
        """A byte-level ``tokenizers`` file; strings of special tokens are plain text."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, own = byte_of_character(), Encoder(path)
        tokens = [b""] * own.vocabulary
        for token, i in spec["model"]["vocab"].items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return cls(lambda texts: [own._one(" " + t) for t in texts], tokens)

    @classmethod
    def pieces(cls, path: str) -> Side:
        """A sentencepiece model that puts a space before the text itself."""
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)

        def spelled(i: int) -> bytes:
            piece = own.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if own.is_byte(i) else piece.replace("▁", " ").encode()

        return cls(lambda texts: own.encode(texts, num_threads=1), [spelled(i) for i in range(own.get_piece_size())])


SIDES: dict[tuple[str, str], Side] = {}


def sides(byte_path: str, piece_path: str) -> tuple[Side, Side]:
    """Both tokenizers, read once per worker."""
    for kind, path in (("byte_level", byte_path), ("pieces", piece_path)):
        if (kind, path) not in SIDES:
            SIDES[kind, path] = getattr(Side, kind)(path)
    return SIDES["byte_level", byte_path], SIDES["pieces", piece_path]


def meets(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the equal values of two strictly ascending lists that end in
    the same value, by diagonal run skipping."""
    first_a: list[int] = []
    first_b: list[int] = []
    length: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        # a run on the diagonal j - i: probe twice the width until a probe fails
        if a[i] == b[j]:
            x, y, width = i + 1, j + 1, START
            while a[x : x + width] == b[y : y + width]:
                x += width
                y += width
                if x >= n or y >= m:  # both sides end in the same value
                    x = n
                    break
                width *= 2
            else:  # the first difference lies within the failed probe
                while width > 1:
                    width //= 2
                    if a[x : x + width] == b[y : y + width]:
                        x += width
                        y += width
            first_a.append(i)
            first_b.append(j)
            length.append(x - i)
            j += x - i
            i = x
            if i >= n or j >= m:
                break
        # an irregular group: the side that is behind goes on until both ends meet
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
    size = np.array(length, np.int64)
    return ragged(np.array(first_a, np.int64), size), ragged(np.array(first_b, np.int64), size)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...`` (``size[k]`` of them) for every k."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)


def linked(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs that share a group, and how often: all pairs of tokens
    of a group.  Groups are given by the index of their last token on each side."""
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    start_a, start_b = last_a - size_a + 1, last_b - size_b + 1
    wide = size_a * size_b > WIDE
    some = ~wide
    of_a = ragged(start_a[some], size_a[some])
    again = np.repeat(size_b[some], size_a[some])  # each token of a meets the group's tokens of b
    of_b = ragged(np.repeat(start_b[some], size_a[some]), again)
    keys, times = np.unique((np.repeat(a[of_a], again) << SHIFT) | b[of_b], return_counts=True)
    if wide.any():
        total: Counter[int] = Counter(dict(zip(keys.tolist(), times.tolist())))
        for g in np.flatnonzero(wide).tolist():
            x, nx = np.unique(a[start_a[g] : last_a[g] + 1], return_counts=True)
            y, ny = np.unique(b[start_b[g] : last_b[g] + 1], return_counts=True)
            total.update(dict(zip(((x[:, None] << SHIFT) | y).ravel().tolist(), (nx[:, None] * ny).ravel().tolist())))
        keys = np.array(sorted(total), np.int64)
        times = np.array([total[k] for k in keys.tolist()], np.int64)
    return keys, times


def spelled_groups(one: Side, two: Side, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of every group, from tables of each side's
    ids with the mark that follows them."""
    end_a, end_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    end_a[last_a], end_b[last_b] = True, True
    # a token's place: those of its own side before it, and the other side's of all earlier groups
    before_b = np.concatenate([[0], last_b[:-1] + 1])
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.repeat(before_b, np.diff(last_a, prepend=-1))] = one.spelled(b"|")[a + end_a * len(one.tokens)]
    out[np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))] = two.spelled(b";")[b + end_b * len(two.tokens)]
    return b"".join(out.tolist())[:-1]


def align(one: Side, two: Side, texts: list[str]):
    """Per text: ids a, ids b, last token of each group in a and in b (arrays);
    ``None`` where a side's bytes are not those of the text."""
    full = [i for i, t in enumerate(texts) if t]
    out: list[tuple | None] = [None] * len(texts)
    some = [texts[i] for i in full]
    for i, text, a, b in zip(full, some, one.encode(some), two.encode(some)):
        want = b" " + text.encode()
        if b"".join(map(one.tokens.__getitem__, a)) != want or b"".join(map(two.tokens.__getitem__, b)) != want:
            continue
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        out[i] = (x, y, *meets(np.cumsum(one.width[x]).tolist(), np.cumsum(two.width[y]).tolist()))
    return out


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, _pairs, _times`` of
    every row."""
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs", "_times"]

    def run(batches):
        one, two = sides(byte_path, piece_path)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                rows = []
                for found in align(one, two, part.column("_text").to_pylist()):
                    if found is None:
                        rows.append((0, 0, 0, 0, "", [], []))
                        continue
                    keys, times = linked(*found)
                    digest = hashlib.sha256(spelled_groups(one, two, *found)).hexdigest()
                    rows.append((*map(len, found[:3]), int(times.sum()), digest, keys, times))
                n_a, n_b, groups, links, digests, keys, times = zip(*rows)
                columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_a, n_b, groups, links)), pa.array(digests, pa.string()),
                           pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, fields)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text"))
    return base.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<long>, _times array<long>")


def pair_counts(made: DataFrame) -> DataFrame:
    """``_pair, _count`` (documents that hold it linked) and ``_best``: whether no
    other pair of its first id has a higher count."""
    counts = made.select(F.explode("_pairs").alias("_pair")).groupBy("_pair").agg(F.count(F.lit(1)).alias("_count"))
    top = counts.groupBy(F.shiftright("_pair", SHIFT).alias("_a")).agg(F.max("_count").alias("_top"))
    both = counts.withColumn("_a", F.shiftright("_pair", SHIFT)).join(top, "_a")
    return both.select("_pair", "_count", (F.col("_count") == F.col("_top")).alias("_best"))


def alignment(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``.

    Null and empty texts, and texts that a side does not spell byte by byte, have
    zeros and an empty digest.  Repeated rows are documents of their own and
    count each; other columns are not looked at; no rows give no rows.
    """
    path = f"{shared_dir(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    aligned(docs, byte_path, piece_path).write.parquet(path)  # encoded once, read twice
    made = docs.sparkSession.read.parquet(path)
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    # one number per row, so that equal rows stay apart; empty lists keep their row
    numbered = made.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select("_row", *facts, F.explode_outer(F.arrays_zip("_pairs", "_times")).alias("_link"))
    rows = rows.select("_row", *facts, F.col("_link._pairs").alias("_pair"), F.col("_link._times").alias("_times"))
    met = join_small(rows, pair_counts(made), ["_pair"], "left")
    best = F.coalesce(F.sum(F.when(F.col("_best"), F.col("_times"))), F.lit(0)).alias("n_best")
    total = F.coalesce(F.sum(F.col("_times") * F.col("_count")), F.lit(0)).alias("count_sum")
    # a row's pairs lie in one task, so all but one line per row is combined before the shuffle
    out = met.groupBy("_row", *facts).agg(best, total)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``doc_id, group_no, a_ids, b_ids, start, end`` (byte offsets in the spaced
    text): the groups themselves, a row each."""

    def run(batches):
        one, two = sides(byte_path, piece_path)
        for batch in batches:
            for start in range(0, len(batch), STEP):
                part = batch.iloc[start : start + STEP]
                rows = []
                for doc, found in zip(part["doc_id"], align(one, two, part["_text"].tolist())):
                    i = j = at = 0
                    for number, (x, y) in enumerate(zip(*found[2:]) if found else ()):
                        a, b = found[0][i : x + 1], found[1][j : y + 1]
                        end = at + int(one.width[a].sum())
                        rows.append((doc, number, a, b, at, end))
                        i, j, at = x + 1, y + 1, end
                yield pd.DataFrame(rows, columns=["doc_id", "group_no", "a_ids", "b_ids", "start", "end"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text"))
    return base.mapInPandas(run, "doc_id long, group_no long, a_ids array<int>, b_ids array<int>, start long, end long")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
