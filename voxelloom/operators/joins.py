"""Joins against tables that are usually, but not provably, small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.session import cut

MAX_BROADCAST_BYTES = 64 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of a materialised table as rows: eight per field, and its texts."""
    wide = [f.name for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(0))
    return df.agg(F.sum(text + 8 * (len(df.columns) + 1))).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               materialise: bool = True, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join voxel rows with a derived table of narrow rows.

    The small side is materialised once and measured.  Up to ``limit`` bytes it
    is broadcast, so the voxel rows are not shuffled and a hot key costs
    nothing; above that both sides are shuffled, whatever the optimizer takes
    their size for, and skew handling splits hot keys (the small side has one
    row per key).
    """
    if materialise:
        small = cut(small)
    small = F.broadcast(small) if size_of(small) <= limit else small.hint("merge")
    return big.join(small, on, how)
