"""Packing documents into fixed-length sequences along a Hilbert curve.

A document's hashed vector (shares of its token ids in hash buckets) is
projected to three dimensions by a fixed random matrix and quantised; the
Hilbert index of the cell is its key.  Documents are range-sorted by key and
laid end to end; the line is cut every ``LENGTH`` ids, so neighbours on the
curve share sequences and nothing is padded.  What is left at the very end is
cut into powers of two.

Ids are made once and kept in the shared folder.  Only (key, length) rows are
range-sorted; each document's place in the line is the total of the partitions
before plus a running sum within its own.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.llm.common import query, table, whole_text
from voxelloom.session import cut

LENGTH, END = 1024, 0
DIMENSIONS, ORDER, BUCKETS, SEED = 3, 10, 4096, 7
#: Spread of a projected coordinate; only sets how evenly the curve's cells fill.
SPREAD = 0.15
# Fixed value: the pattern by which byte-level vocabularies of this kind cut a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where that is printable,
    and the others, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file.

    A byte-level file whose ids are in the order of its merges is read as a
    table of ranks, which gives the same ids at a third of the time; any other
    file is left to its own library, and so is every text that holds one of the
    file's added tokens.  With ``added`` their strings in a text get the added
    tokens' ids, as the library does of itself; without, they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        self.path, self.added, self._one, self._own, self._marks = path, added, self.whole, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        vocabulary = model["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges") or []]
        self.vocabulary = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and spec["normalizer"] is None
        if plain and model.get("type", "BPE") == "BPE" and merged and merged == sorted(merged):
            import tiktoken

            byte, strings = byte_of_character(), {t["content"] for t in spec["added_tokens"]}
            ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in strings}
            self._one = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            if added and strings:
                self._marks = re.compile("|".join(map(re.escape, strings)))

    def whole(self, text: str) -> list[int]:
        """Ids by the file's own library, read when first needed."""
        if self._own is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
            self._own.encode_special_tokens = not self.added
        return self._own.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = self._marks.search if self._marks else lambda text: None
        return [np.array(self.whole(t) if marked(t) else self._one(t), np.uint32) for t in texts]


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path, added=True)
    return ENCODERS[path]


def hash_buckets(vocabulary: int) -> np.ndarray:
    """Hash bucket of each id."""
    mixed = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(52)).astype(np.int64) % BUCKETS


def projection() -> np.ndarray:
    """Fixed random matrix from hashed vectors to the curve's dimensions."""
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))


def hilbert(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert index of integer cells (rows) in a cube of side 2**order:
    undo the excess rotations from the finest bit on, Gray-encode, interleave."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> bit & 1)
    return out


def curve_key(ids: list[np.ndarray], bucket: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hilbert key of each document; documents without ids lie at the centre."""
    at = np.array([np.bincount(bucket[i], minlength=BUCKETS) @ matrix / max(1, len(i)) for i in ids]).reshape(-1, DIMENSIONS)
    side = 1 << ORDER
    return hilbert(np.clip((side / (1 + np.exp(-1.7 * at / SPREAD))).astype(np.int64), 0, side - 1))


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """``_row, doc_id, _key, _n, _ids``, materialised; ids are compressed
    little-endian unsigned 32-bit numbers and end with id 0."""

    def run(batches):
        import zstandard

        enc, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        bucket, matrix = hash_buckets(enc.vocabulary), projection()
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                ids = enc.encode(part["_text"].tolist())
                keys = curve_key(ids, bucket, matrix)
                full = [np.append(x, np.uint32(END)).astype("<u4") for x in ids]
                yield pd.DataFrame({"_row": part["_row"], "doc_id": part["doc_id"], "_key": keys, "_n": [len(x) for x in full],
                                    "_ids": [pack.compress(shrink(x)) for x in full]})

    base = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", whole_text().alias("_text"))
    return cut(base.mapInPandas(run, "_row long, doc_id long, _key long, _n long, _ids binary"))


def shrink(ids: np.ndarray) -> bytes:
    """Low and high halves apart: both compress better than in turns."""
    half = ids.view("<u2").reshape(-1, 2)
    return half[:, 0].tobytes() + half[:, 1].tobytes()


def grow(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2").reshape(2, -1).T.copy().view("<u4").ravel()


def places(made: DataFrame) -> tuple[DataFrame, int]:
    """(``_row, _at``: ids before each document along the curve; all ids)."""
    line = made.select("_key", "doc_id", "_row", "_n").repartitionByRange("_key", "doc_id", "_row").sortWithinPartitions("_key", "doc_id", "_row")

    def run(batches):
        held = 0
        for b in batches:
            n = b["_n"].to_numpy()
            yield pd.DataFrame({"_part": b["_part"], "_row": b["_row"], "_in": held + np.cumsum(n) - n, "_n": n})
            held += int(n.sum())

    run_in = cut(line.select(F.spark_partition_id().alias("_part"), "_row", "_n").mapInPandas(run, "_part int, _row long, _in long, _n long"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = run_in.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # one row per partition
    shift = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    total = totals.agg(F.sum("_sum")).first()[0] or 0
    return run_in.join(F.broadcast(shift), "_part").select("_row", (F.col("_in") + F.col("_shift")).alias("_at")), int(total)


def sequence_bounds(total: int, length: int) -> np.ndarray:
    """Where the sequences after the last full one start, and the end."""
    at, out = total - total % length, [total - total % length]
    for bit in range(length.bit_length(), -1, -1):
        if (total % length) >> bit & 1:
            at += 1 << bit
            out.append(at)
    return np.array(out)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    if wanted, ``ids``: every id of every row in exactly one piece.

    Null text counts as empty (a document of the end id alone); repeated rows
    are packed each; ties on the curve go by doc_id.
    """
    made = tokenised(docs, path)
    at, total = places(made)
    tail = sequence_bounds(total, length)
    full = total // length
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, begin, data in zip(b["doc_id"], b["_at"].tolist(), b["_ids"]):
                ids = grow(open_.decompress(data))
                end = begin + len(ids)
                inner = np.arange(begin // length + 1, min(end, full * length) // length + 1) * length
                marks = np.unique(np.concatenate([[begin, end], inner, tail]))
                marks = marks[(marks >= begin) & (marks <= end)].tolist()
                for a, z in zip(marks, marks[1:]):
                    if a < full * length:
                        number, first = a // length, a - a % length
                    else:
                        k = int(np.searchsorted(tail, a, side="right")) - 1
                        number, first = full + k, int(tail[k])
                    part = ids[a - begin : z - begin]
                    rows.append((doc, a - begin, z - a, zlib.crc32(part.tobytes()), len(ids), number, a - first, *([part.astype(np.int32)] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    joined = made.select("_row", "doc_id", "_ids").join(at.hint("shuffle_hash"), "_row")
    return joined.select("doc_id", "_at", "_ids").mapInPandas(run, schema)


@query("op2_pack_hilbert")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
