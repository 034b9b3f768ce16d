"""Row generators and sequences."""


import pandas as pd
from pyspark.sql import functions as F

from ..plans.tables import shared_path
from ..registry import query
from ..streaming import sequences as seq


@query("SELECT p_partkey, unnest(range(p_size)) AS id FROM part")
def generate_range(t):
    """The naturals below each part's size."""
    return t.part.where("p_size > 0").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_size").cast("long") - 1)).alias("id"))


@query("SELECT p_partkey, unnest(range(p_size % 7 - 5, p_size % 11)) AS id FROM part")
def generate_integers(t):
    """The integers from one bound up to another of each part; none where the second is not above the first."""
    low, high = (F.col("p_size") % 7 - 5).cast("long"), (F.col("p_size") % 11).cast("long")
    return t.part.where(low < high).select("p_partkey", F.explode(F.sequence(low, high - 1)).alias("id"))


@query("SELECT n_nationkey, CAST(greatest(n_regionkey * 2 - 3, 0) AS INT) AS n, array_to_string(range(3, n_regionkey * 2), ',') AS items FROM nation")
def generate_interval_lists(t):
    """[3, m) as a list and its length, empty where m is not above 3."""
    m = F.col("n_regionkey") * 2
    items = F.when(m > 3, F.sequence(F.lit(3), F.greatest(m - 1, F.lit(3)))).otherwise(F.array().cast("array<int>"))
    return t.nation.select("n_nationkey", F.size(items).alias("n"), F.array_join(items.cast("array<string>"), ",").alias("items"))


@query("SELECT p_partkey, i, p_size - i AS j FROM part, unnest(range(p_size + 1)) u(i)")
def generate_antidiagonal(t):
    """The pairs of naturals whose sum is each part's size."""
    size = F.col("p_size").cast("long")
    return t.part.select("p_partkey", size.alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), size)).alias("i")).select("p_partkey", "i", (F.col("s") - F.col("i")).alias("j"))


@query("SELECT p_partkey, ((p_size + 3) * (p_size + 2) * (p_size + 1) // 6)::BIGINT AS n FROM part")
def count_compositions(t):
    """Ways to write each part's size as four naturals: each summand added by a sum over what is left, not by a product."""
    top = t.part.agg(F.max("p_size").cast("long").alias("top"))
    ways = top.select(F.lit(0).cast("long").alias("total"), F.lit(1).cast("long").alias("n"), "top").where("top IS NOT NULL")
    for _ in range(4):
        ways = ways.select(F.explode(F.sequence("total", "top")).alias("total"), "n", "top").groupBy("total", "top").agg(F.sum("n").alias("n"))
    return t.part.join(F.broadcast(ways.select("total", "n")), F.col("p_size") == F.col("total")).select("p_partkey", "n")


@query("SELECT n_nationkey, a, b, n_regionkey - a - b AS c FROM nation, range(10) x(a), range(10) y(b) WHERE a + b <= n_regionkey")
def sparse_maps_with_total(t):
    """The maps from three keys to naturals with a given sum, the key of each nation's region."""
    total = F.col("n_regionkey").cast("long")
    first = t.nation.select("n_nationkey", total.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), total)).alias("a"))
    return first.select("n_nationkey", "n", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a"))).alias("b")).select("n_nationkey", "a", "b", (F.col("n") - F.col("a") - F.col("b")).alias("c"))


@query("SELECT event_type, count(*) AS n, TRUE AS low, TRUE AS high, TRUE AS again, TRUE AS fair FROM events GROUP BY event_type")
def generate_random(t):
    """A number from 5 to 5 + value for each event and a coin, under seeds: within bounds, equal in a second run, and the coin fair within six deviations."""
    draw = lambda: t.events.select("event_id", "event_type", "value", (F.floor(F.rand(7) * (F.floor("value") + 1)) + 5).alias("x"), (F.rand(8) < 0.5).alias("coin"))
    same = draw().join(draw().select("event_id", F.col("x").alias("y"), F.col("coin").alias("again")), "event_id")
    heads, n = F.count_if("coin"), F.count(F.lit(1))
    within = F.abs(2 * heads - n) <= 6 * F.sqrt(n)
    return same.groupBy("event_type").agg(n.alias("n"), (F.min("x") >= 5).alias("low"), F.bool_and(F.col("x") <= F.floor("value") + 5).alias("high"), F.bool_and((F.col("x") == F.col("y")) & (F.col("coin") == F.col("again"))).alias("again"), within.alias("fair"))


@query("SELECT p_partkey, i AS seq, (p_size * pow(2, i))::BIGINT AS x FROM part, range(12) r(i)")
def generate_iterates(t):
    """Each part's size and its doubles, twelve of them, by iterating a map."""
    states = F.aggregate(F.sequence(F.lit(2), F.lit(12)), F.array(F.col("p_size").cast("long")), lambda a, _: F.array_append(a, F.element_at(a, -1) * 2))
    return t.part.select("p_partkey", F.posexplode(states).alias("seq", "x")).withColumn("seq", F.col("seq").cast("long"))


def _ab(t):
    a = t.nation.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("x"))
    return a, a.withColumn("x", F.lower("x"))


@query("SELECT n_nationkey::BIGINT * 2 AS seq, n_name AS x FROM nation UNION ALL SELECT n_nationkey::BIGINT * 2 + 1, lower(n_name) FROM nation")
def sequence_interleave(t):
    return seq.interleave(*_ab(t))


@query("SELECT (n_nationkey // 2)::BIGINT AS seq, n_name AS x, n_nationkey % 2 AS side FROM nation")
def sequence_even_odd(t):
    a, _ = _ab(t)
    return seq.even(a).withColumn("side", F.lit(0)).unionByName(seq.odd(a).withColumn("side", F.lit(1)))


@query("SELECT n_nationkey::BIGINT + 2 AS seq, n_name AS x FROM nation UNION ALL SELECT * FROM (VALUES (0::BIGINT, 'p'), (1, 'q')) v(seq, x)")
def sequence_prepend(t):
    return seq.prepend(["p", "q"], _ab(t)[0])


@query("SELECT n_nationkey::BIGINT AS seq, n_name AS x FROM nation WHERE n_nationkey % 3 <> 0")
def sequence_without_pauses(t):
    a, _ = _ab(t)
    return seq.without_pauses(a.withColumn("x", F.when(F.col("seq") % 3 != 0, F.col("x"))))


@query("SELECT a.n_nationkey::BIGINT AS seq, a.n_name || b.n_name AS x FROM nation a JOIN nation b USING (n_nationkey)")
def sequence_zip(t):
    a, b = _ab(t)
    return a.join(b.select("seq", F.upper("x").alias("y")), "seq").select("seq", F.concat("x", "y").alias("x"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(t):
    """The events as a stream of files, counted per day and type with a watermark, run until all of it is read."""
    schema = t.events.schema
    path = shared_path(t.spark, "stream")
    t.events.write.parquet(path)
    s = t.spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = seq.windowed_totals(s, "ts", "event_type", "value", "1 day", "60 days")
    rows = seq.run_to_end(out, "daily", "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_stateful_unfold(t):
    """A running state per key over micro-batches; the last state of each key is its number of events."""
    schema = t.events.schema
    path = shared_path(t.spark, "stream")
    t.events.write.parquet(path)

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        n = state[0] + len(rows)
        return (n,), pd.DataFrame({"user_id": rows["user_id"].iloc[:1], "n": [n]})

    s = t.spark.readStream.schema(schema).parquet(path).select("user_id", "event_id")
    out = seq.unfold(s, "user_id", "user_id long, n long", "n long", step, (0,))
    rows = seq.run_to_end(out, "unfold")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"))


@query("SELECT event_id, event_type || '!' AS x FROM events")
def stream_map(t):
    path = shared_path(t.spark, "stream")
    t.events.select("event_id", F.col("event_type").alias("x")).write.parquet(path)
    s = t.spark.readStream.schema("event_id long, x string").parquet(path)
    return seq.run_to_end(seq.mapped(s, lambda x: F.concat(x, F.lit("!"))), "mapped")
