"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def salted_lookup(rows: DataFrame, values: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one row per ``key`` of ``values`` when a key may own
    a large share of the rows.

    Only the (key, salt) pairs that occur meet the values by key, at most one
    row per salt; the rows themselves meet their pair by (key, salt), so a hot
    key is spread over as many tasks as there are salts.
    """
    pairs = rows.select(key, salt).distinct().join(values, key, "inner")
    return rows.join(pairs, [key, salt], how)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once; used inside a lambda as it
    is, it would be evaluated anew for every element."""
    return F.transform(F.array(value), body)[0]
