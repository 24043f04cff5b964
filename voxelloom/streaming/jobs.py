"""Incremental arrival as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick_up(spark: SparkSession, folder: str, schema, checkpoint: str, handle: Callable[[DataFrame, int], None],
            max_files: int | None = None, fmt: str = "parquet"):
    """Process every file of ``folder`` once, also over restarts; new files are
    taken up by the next run with the same checkpoint."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (reader.load(folder).writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(handle).start())


def batch_to_table(transform: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes each batch to its own folder, so a replayed batch
    overwrites instead of duplicating."""

    def handle(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def running_means(stream: DataFrame, run: str, file: str, metrics: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Score ledger: one score per run and file, running macro means per run.

    With a time column the duplicate check keeps state for ``delay`` only.
    """
    once = (stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([run, file]) if time
            else stream.dropDuplicates([run, file]))
    return once.groupBy(run).agg(F.count(F.lit(1)).alias("files"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def keep_ledger(stream: DataFrame, path: str, checkpoint: str, run: str, file: str, metrics: list[str], time: str, delay: str = "1 day"):
    """Start the ledger in update mode: every batch writes only the runs it
    changed, into a folder of its own that a replayed batch overwrites.

    State is one row per run and, for ``delay``, one per file.  A score that
    comes later than ``delay`` behind the newest one is not counted.
    """
    means = running_means(stream, run, file, metrics, time, delay)
    return (means.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(batch_to_table(lambda batch: batch, path)).start())


def read_ledger(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The newest row of each run."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (run, "batch")]
    return rows.groupBy(run).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(run, *[F.col(f"_v.{c}") for c in values])
