"""Matching files, models and scores by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.joins import join_small
from voxelloom.operators.ordered import prefix_totals
from voxelloom.session import parallelism


#: Bytes of needle heads up to which they are sent to every task; more are joined by shuffle.
MAX_HEADS = 8 << 20


def contains_match(needles: DataFrame, haystack: DataFrame, needle: str, text: str, order: str, out: str) -> DataFrame:
    """First row of ``haystack`` (by ``order``) whose ``text`` contains the needle.

    A place of a text counts if some needle's head (its first 1, 2, 4, 8, ...
    characters, the most that it has) stands there.  From those places every
    substring with a needle's length is hashed to its first owner, so the
    containment test is an equi-join.
    """
    lengths = [r[0] for r in needles.select(F.length(needle)).distinct().collect() if r[0]]  # as many as names have lengths
    sizes = sorted({1 << (n.bit_length() - 1) for n in lengths})
    size = F.length(text)

    def among(numbers):
        return F.array(*[F.lit(n) for n in numbers]).cast("array<int>")

    head = F.lit(None).cast("string")
    for k in sizes:
        head = F.when(F.length(needle) >= k, F.substring(needle, 1, k)).otherwise(head)
    heads = needles.select(head.alias("_head")).where("_head is not null").distinct()
    # a declared count: names are few bytes, but many places
    texts = haystack.select(text, order, F.col(out).alias("_out")).repartition(parallelism(needles.sparkSession))
    places = texts.select("*", F.explode(F.filter(among(sizes), lambda k: k <= size)).alias("_k"))
    places = places.select("*", F.explode(F.sequence(F.lit(1), size - F.col("_k") + 1)).alias("_i"))
    places = places.withColumn("_head", F.substring(F.col(text), F.col("_i"), F.col("_k")))
    live = join_small(places, heads, ["_head"], "left_semi", limit=MAX_HEADS)
    fitting = F.filter(among(lengths), lambda n: (n >= F.col("_k")) & (n < 2 * F.col("_k")) & (n <= size - F.col("_i") + 1))
    pieces = live.select(text, order, "_out", "_i", F.explode(fitting).alias("_n"))
    first = pieces.groupBy(F.substring(F.col(text), F.col("_i"), F.col("_n")).alias("_piece")).agg(F.min(F.struct(order, "_out")).alias("_first"))
    # sizes estimated behind an explode are too small, so a broadcast is ruled out
    return needles.join(first.hint("merge"), F.col(needle) == F.col("_piece"), "left").select(
        *needles.columns, F.col("_first._out").alias(out))


def pair_by_position(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Sorted lists zipped by position; fails unless both have the same length."""
    a = prefix_totals(left.select(left_key), [], [left_key]).select("rn", left_key, F.col("rows_total").alias("_na"))
    b = prefix_totals(right.select(right_key), [], [right_key]).select("rn", right_key, F.col("rows_total").alias("_nb"))
    both = a.join(b, "rn", "full")
    check = F.assert_true(F.col("_na").isNotNull() & F.col("_nb").isNotNull(), F.lit("lists differ in length"))
    return both.where(check.isNull()).select("rn", left_key, right_key)


def role_table(files: DataFrame, roles: list[str]) -> DataFrame:
    """``base`` with one column per role and the missing roles by name.

    ``files``: base, role, path.
    """
    wide = files.groupBy("base").agg(*[F.min(F.when(F.col("role") == r, F.col("path"))).alias(r) for r in roles])
    missing = F.concat_ws(", ", *[F.when(F.col(r).isNull(), F.lit(r)) for r in roles])
    return wide.withColumn("missing", missing)
