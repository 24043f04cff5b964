from pyspark.sql import functions as F

from voxelloom.streaming import jobs as J

SCHEMA = "run string, file long, scored timestamp, dice double"


def ledger(spark, base, rows):
    """Let ``rows`` of (run, file, day, score) arrive, then run the job once."""
    new = spark.createDataFrame([(r, f, d, s) for r, f, d, s in rows], "run string, file long, day int, dice double")
    new = new.select("run", "file", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)").alias("scored"), "dice")
    new.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
    query = J.keep_ledger(stream, f"{base}/out", f"{base}/check", "run", "file", ["dice"], "scored", "5 days")
    query.awaitTermination()
    state = [s for p in query.recentProgress for s in p["stateOperators"]]
    found = {r.run: (r.files, round(r.mean_dice, 6)) for r in J.read_ledger(spark, f"{base}/out", "run").collect()}
    return found, state


def test_ledger_over_restarts(spark, tmp_path):
    base = str(tmp_path)
    assert ledger(spark, base, [("a", 1, 0, 0.5), ("a", 2, 1, 0.7), ("b", 1, 1, 0.4), ("a", 1, 0, 0.5)])[0] == {"a": (2, 0.6), "b": (1, 0.4)}
    # a duplicate after a restart is not counted again, and a run without news keeps its row
    assert ledger(spark, base, [("a", 2, 1, 0.7), ("a", 3, 2, 0.9)])[0] == {"a": (3, 0.7), "b": (1, 0.4)}


def test_ledger_state_is_bounded(spark, tmp_path):
    base = str(tmp_path)
    for step in range(3):  # each step is ten days on
        _, state = ledger(spark, base, [("a", 100 * step + i, 10 * step, 1.0) for i in range(50)])
    rows = sum(s["numRowsTotal"] for s in state[-2:])
    assert rows <= 1 + 50  # one run, and only the files of the last step
    # behind the watermark a duplicate cannot be told from a new score: neither counts
    assert ledger(spark, base, [("a", 0, 0, 0.0), ("a", 999, 1, 0.0)])[0] == {"a": (150, 1.0)}
