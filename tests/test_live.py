"""Streams that are stopped and started again, and what their state keeps."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import endless, late


def test_places_go_on_from_the_checkpoint(spark):
    run = endless.Run(spark, "t")
    run.until_read(endless.cycle(spark, ["a", "b"], 7, until=20))
    first = set(run.batches)
    run.until_read(endless.cycle(spark, ["a", "b"], 7, until=45))
    assert len(first) == 3 and len(run.batches) > 3
    assert sorted(tuple(r) for r in run.read().collect()) == [(i, "ab"[i % 2]) for i in range(45)]
    with pytest.raises(ValueError):
        endless.cycle(spark, [])


def test_replay_of_an_empty_table(spark):
    table = spark.createDataFrame([], "seq long, x string")
    assert endless.Run(spark, "none").until_read(endless.replayed(table)).read().count() == 0


#: Spark takes event time to begin at 0.
BASE = 3_600_000


def rows_of(spark, times):
    rows = [(i, k, t) for i, (k, t) in enumerate(times)]
    return spark.createDataFrame(rows, "seq long, k string, s long").select("seq", "k", F.timestamp_seconds(F.col("s") + BASE).alias("ts"), F.lit(1.25).alias("value"))


def test_stalls_in_batches_between_them_and_at_the_end(spark):
    times = [("a", 0), ("b", 1), ("a", 50), ("b", 5000), ("c", 5001), ("a", 9000), ("c", 9001), ("c", 20000), ("c", 20001)]
    for size in (1, 2, 9):
        table = rows_of(spark, times)
        found = endless.Run(spark, "s").until_read(late.stalls(endless.replayed(table, size), "k", "ts", 3_600_000)).read()
        got = sorted((r["k"], r["since_ms"] // 1000 - BASE) for r in found.collect())
        assert got == [("a", 50), ("a", 9000), ("b", 1), ("b", 5000), ("c", 5001), ("c", 9001)]


def test_reported_keys_keep_no_state(spark):
    times = [(f"k{i}", i) for i in range(40)] + [("z", 100_000), ("z", 100_001), ("z", 100_002)]
    run = endless.Run(spark, "s").until_read(late.stalls(endless.replayed(rows_of(spark, times), 10), "k", "ts", 3_600_000))
    assert run.read().count() == 40
    assert run.progress[-1].stateOperators[0].numRowsTotal == 1


def test_state_is_kept_per_bucket_of_keys(spark):
    """More keys than buckets, a NULL among them and more rows than an Arrow batch: few rows of state, and the waits of each key."""
    # three rows of each key, waits of 5000 s and of 100 s; every seventh key has the first two alone
    keys = [None, *range(10**17, 10**17 + 300)]
    times = sorted(((k, t + i) for i, k in enumerate(keys) for t in (0, 5000, 5100) if t < 5100 or i % 7), key=lambda x: x[1])
    table = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(times)], "seq long, k long, s long").select("seq", "k", F.timestamp_seconds(F.col("s") + BASE).alias("ts"))
    for batch, most in ((len(times), 10_000), (200, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            run = endless.Run(spark, "s").until_read(late.stalls(endless.replayed(table, batch), "k", "ts", 3_600_000, buckets=8))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        got = sorted((r["k"] or 0, r["since_ms"] // 1000 - BASE) for r in run.read().collect())
        assert got == sorted((k or 0, i) for i, k in enumerate(keys))
        assert run.progress[-1].stateOperators[0].numRowsTotal <= 9


def test_late_rows_are_a_second_output(spark):
    times = [("a", 10), ("a", 3700), ("a", 20), ("b", 90), ("a", 7300), ("b", 3650), ("b", 30), ("b", 7400)]
    done = late.TotalsAndLate(spark, "ts", "value", 3_600_000, 60_000).run(endless.replayed(rows_of(spark, times), 2))
    # marks before the batches: none, 3640 s, 3640 s, 7240 s
    assert sorted(r["seq"] for r in done.late().collect()) == [2, 3, 6]
    assert sorted((r["start_ms"] - BASE * 1000, r["n"], r["total"]) for r in done.windows().collect()) == [(0, 1, 125), (3_600_000, 2, 250)]


def test_interval_join_drops_what_no_row_can_reach(spark):
    times = [(k, t) for t in range(0, 100_000, 500) for k in "ab"]
    table = rows_of(spark, times)
    a = endless.replayed(table, 40).where("k = 'a'").select("k", F.col("ts").alias("at_a"))
    b = endless.replayed(table, 40).where("k = 'b'").select(F.lit("a").alias("k"), F.col("ts").alias("at_b"))
    run = endless.Run(spark, "j").until_read(late.joined_within(a, b, "k", "at_a", "at_b", "1000 SECONDS", "1 second"))
    assert run.read().count() == 3 * 200 - 3
    assert run.progress[-1].stateOperators[0].numRowsTotal < 150
