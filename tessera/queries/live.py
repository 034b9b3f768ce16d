"""The events as endless and timed streams, each with the SQL of the whole table."""

from pyspark.sql import functions as F

from ..operators.relations import ordinal
from ..plans.tables import shared_path, write_once
from ..registry import query
from ..streaming import endless, late

_PLACED = "p AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, * FROM events)"


def _placed(t, *columns):
    """The events numbered by time, in files sorted by their place, with time as a timestamp."""
    rows = ordinal(t.events.select("ts", "event_id", *columns), "ts", "event_id", name="seq").withColumn("ts", F.col("ts").cast("timestamp"))
    path = shared_path(t.spark, "placed")
    rows.sort("seq").write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


def _batch(n):
    """Rows of a micro-batch: six batches for the table."""
    return max(1, -(-n // 6))


@query(f"WITH {_PLACED} SELECT event_id, seq AS nat, 7 AS const, ['a', 'b', 'c'][(seq % 3 + 1)::INT] AS cyc FROM p")
def endless_sequences_beside_events(t):
    """The naturals, a constant and a cycle, zipped with the events by place; stopped half-way and started again from the checkpoint."""
    table = _placed(t)
    n = table.count()

    def zipped(until):
        s = endless.replayed(table, _batch(n), until)
        names = F.array(*[F.lit(x) for x in "abc"])
        return s.select("event_id", F.col("seq").alias("nat"), F.lit(7).alias("const"), F.get(names, (F.col("seq") % 3).cast("int")).alias("cyc"))

    run = endless.Run(t.spark, "endless")
    run.until_read(zipped(n // 2)).until_read(zipped(n))
    return run.read()


@query(
    "WITH g AS (SELECT user_id, (epoch_us(ts) // 1000) AS tm, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, max((epoch_us(ts) // 1000)) OVER () AS top FROM events) "
    "SELECT user_id, count(*) FILTER (nxt - tm > 3600000) AS between_rows, count(*) FILTER (nxt IS NULL AND tm + 3601001 <= top) AS at_end FROM g WHERE nxt - tm > 3600000 OR (nxt IS NULL AND tm + 3601001 <= top) GROUP BY user_id"
)
def stream_stalls(t):
    """Waits of more than an hour, found by timers while no row arrives or by the next row; the last one of a user has no next row."""
    table = _placed(t, "user_id")
    s = endless.replayed(table, _batch(table.count()))
    found = write_once(endless.Run(t.spark, "stalls").until_read(late.stalls(s, "user_id", "ts", 3_600_000)).read())
    last = table.groupBy("user_id").agg(F.unix_millis(F.max("ts")).alias("last_ms"))
    both = found.join(last, "user_id").withColumn("ended", F.col("since_ms") == F.col("last_ms"))
    return both.groupBy("user_id").agg(F.count_if(~F.col("ended")).alias("between_rows"), F.count_if("ended").alias("at_end"))


#: The events in an order that scatters them over a day, in six batches; what comes after the greatest time of earlier batches less six hours is late.
_SCATTERED = (
    "s AS (SELECT *, row_number() OVER (ORDER BY (epoch_us(ts) // 1000) + (event_id * 7919 % 1440) * 60000, event_id) - 1 AS seq FROM events), "
    "b AS (SELECT *, seq // ((SELECT ((count(*) + 5) // 6) FROM events)) AS batch FROM s), "
    "m AS (SELECT batch, max(max((epoch_us(ts) // 1000))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 21600000 AS mark FROM b GROUP BY batch), "
    "r AS (SELECT b.*, (epoch_us(ts) // 1000) AS tm, coalesce((epoch_us(ts) // 1000) < mark, FALSE) AS late FROM b JOIN m USING (batch))"
)


def _scattered(t):
    key = F.unix_millis(F.col("ts").cast("timestamp")) + (F.col("event_id") * 7919 % 1440) * 60000
    rows = ordinal(t.events.select(key.alias("k"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value"), "k", "event_id", name="seq").drop("k")
    path = shared_path(t.spark, "scattered")
    rows.sort("seq").write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    f"WITH {_SCATTERED} SELECT CASE WHEN late THEN 'late' ELSE 'window' END AS kind, tm - tm % 3600000 AS start_ms, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM r "
    "WHERE late OR tm - tm % 3600000 + 3600000 <= (SELECT max(tm) - 21600000 FROM r) GROUP BY late, start_ms"
)
def stream_late_rows(t):
    """Hourly totals of scattered events by a watermark of six hours, and the rows that came too late for it, counted by hour."""
    table = _scattered(t)
    s = endless.replayed(table, _batch(table.count()))
    done = late.TotalsAndLate(t.spark, "ts", "value", 3_600_000, 21_600_000).run(s)
    ms = F.unix_millis("ts")
    behind = done.late().groupBy((ms - F.pmod(ms, F.lit(3_600_000))).alias("start_ms")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return done.windows().withColumn("kind", F.lit("window")).unionByName(behind.withColumn("kind", F.lit("late")))


@query("SELECT b.user_id, count(*) AS n, min(epoch_us(b.ts) - epoch_us(a.ts)) AS nearest FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND a.ts BETWEEN b.ts - INTERVAL 2 HOUR AND b.ts GROUP BY 1")
def stream_interval_join(t):
    """Purchases with the same user's views of the two hours before, two streams joined with state bounded by the interval."""
    table = _placed(t, "user_id", "event_type")
    size = _batch(table.count())
    views = endless.replayed(table, size).where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"))
    purchases = endless.replayed(table, size).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"))
    pairs = late.joined_within(views, purchases, "user_id", "seen", "bought", "2 HOURS", "1 second")
    rows = endless.Run(t.spark, "interval").until_read(pairs).read()
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("bought") - F.unix_micros("seen")).alias("nearest"))
