"""Streams over several runs and micro-batches against the batch folds."""

import random

from pyspark.sql import functions as F

from terraloom.operators import folds, records
from terraloom.streaming import logs


def run(spark, folder, df, make):
    """Adds a file of rows to the stream's source and runs it until all is read; returns all results so far and the rows of state."""
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    made = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    q = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), q.recentProgress[-1].stateOperators[0].numRowsTotal


def attempts(spark, rows):
    return spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))


def test_limits_equal_batch_over_runs(spark, tmp_path):
    rng = random.Random(3)
    rows = [(u, s) for u in range(3) for s in rng.sample(range(4000), 60)]
    parts = [[r for r in rows if lo <= r[1] < lo + 1000] for lo in range(0, 4000, 1000)]
    for name, make, batch in (("f", lambda d: logs.fixed_window(d, 300, 5), folds.fixed_window(attempts(spark, rows), "user_id", "ts", 300, 5)), ("s", lambda d: logs.sliding_window(d, 300, 5), folds.sliding_window(attempts(spark, rows), "user_id", "ts", 300, 5))):
        for part in parts:
            rng.shuffle(part)
            out, state = run(spark, tmp_path / name, attempts(spark, part), make)
        got = {(r.user_id, r.us, r.allowed, r.late) for r in out.select("user_id", F.unix_micros("ts").alias("us"), "allowed", "late").collect()}
        assert state == 3 and got == {(r.user_id, r.at_us, r.allowed, False) for r in batch.collect()} and {x[2] for x in got} == {True, False}


def test_late_rows(spark, tmp_path):
    run(spark, tmp_path, attempts(spark, [(1, 100), (1, 101), (2, 50)]), logs.sliding_window)
    out, state = run(spark, tmp_path, attempts(spark, [(1, 99)]), logs.sliding_window)
    assert state == 2 and [(r.allowed, r.late) for r in out.where("user_id = 1").orderBy("ts").collect()] == [(None, True), (True, False), (True, False)]


def test_deliveries_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(d, s, i, rng.choice(["claim", "claim", "provider_accepted", "failed"])) for d in range(4) for i, s in enumerate(sorted(rng.sample(range(0, 100_000, 50), 25)))]
    df = spark.createDataFrame(rows, "submission_id long, at_s long, seq long, action string")
    for lo in (0, 40_000, 80_000):
        out, _ = run(spark, tmp_path, df.where(F.col("at_s").between(lo, lo + 39_999)).select("submission_id", F.timestamp_seconds("at_s").alias("ts"), "seq", "action"), logs.deliveries)
    pick = lambda d: {(r.submission_id, r.seq, r.state, r.send, r.attempts) for r in d.collect()}
    assert pick(out) == pick(records.deliveries(df)) and {r.state for r in out.collect()} >= {"sending", "failed", "provider_accepted"}
