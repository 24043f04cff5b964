"""Exact deduplication with skew-safe combining.

Rows meet in three steps, each of which groups by the *whole text* beside its
digest, so that equal digests of different texts are never merged: equal texts
are combined inside each task (map-side aggregation), then inside each salted
digest group, then the winners of the salts are combined per digest.  No step
gathers the members of a group; what moves for a group of any size is one row
per task, then one per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.common import fresh, query, salted_lookup, table, whole_text
from voxelloom.session import cut

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest``: one row per input row.

    Texts are equal when identical, null being empty; the largest ``doc_id``
    stays.  Rows that repeat a doc_id together with its text get the same
    verdict, and a null doc_id loses to every other (a group of null ids alone
    is kept with ``keep_id`` null).  No rows in, no rows out.
    """
    keyed = docs.select(F.col("doc_id").alias("doc_id"), whole_text().alias("_text")).select(
        "doc_id", "_text", digest(F.col("_text")).alias("_digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt"))
    local = keyed.groupBy("_digest", "_salt", "_text").agg(F.max("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    # dealt by digest alone, so that the variants of a digest also meet without another shuffle
    merged = local.repartition("_digest").groupBy("_digest", "_text").agg(
        F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_list("_salt").alias("_salts"))
    winners = cut(merged.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_variants"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
        F.array_distinct(F.flatten(F.collect_list("_salts"))).alias("_salts")))

    single = winners.where("_variants = 1").select("_digest", F.explode("_salts").alias("_salt"), "keep_id", "group_size")
    out = keyed.select("doc_id", "_digest", "_salt").join(single, ["_digest", "_salt"])
    clash = winners.where("_variants > 1").select("_digest")
    if not clash.isEmpty():
        # different texts behind one digest: their rows are settled by the text itself
        member = keyed.join(clash, "_digest", "left_semi")
        per_text = member.groupBy("_digest", "_salt", "_text").agg(F.max("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
        per_text = per_text.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
        exact = member.join(per_text, ["_digest", "_text"])
        out = out.select("doc_id", "_digest", "keep_id", "group_size").unionByName(
            exact.select("doc_id", "_digest", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("_digest").alias("digest"))


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    id_, digest_ = fresh(docs, "_lost", "_digest")
    lost = groups(docs, salts).where("not kept").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_)).distinct()
    return docs.join(lost, F.col("doc_id").eqNullSafe(F.col(id_)) & (sha256(whole_text()) == F.col(digest_)), "left_anti")


@query("op8_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op8(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")
