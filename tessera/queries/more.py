"""Operators that complete the algebra, and Spark's own joins, groupings, windows and sources over the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import more as X
from ..plans.tables import shared_path
from ..registry import query
from ..streaming import sequences as seq


@query("SELECT n_nationkey FROM nation WHERE n_nationkey <= 7")
def interval_up_to(t):
    """x <= b, with no lower end."""
    return t.nation.where("n_nationkey <= 7").select("n_nationkey")


@query("SELECT user_id, bool_or(value > 90) AS some_high, bool_and(value >= 0) AS all_positive FROM events GROUP BY user_id")
def any_and_all(t):
    return t.events.groupBy("user_id").agg(F.bool_or(F.col("value") > 90).alias("some_high"), F.bool_and(F.col("value") >= 0).alias("all_positive"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a, nation b, nation c WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey")
def sets_of_three(t):
    """The sets of a given size: rising triples of the nations."""
    n = t.nation.select(F.col("n_nationkey").alias("a"))
    return n.join(n.select(F.col("a").alias("b")), F.col("a") < F.col("b")).join(n.select(F.col("a").alias("c")), F.col("b") < F.col("c"))


@query("SELECT p_partkey, (p_size < 10)::INT * 4 + (p_retailprice > 1000)::INT * 2 + (p_brand LIKE '%1')::INT AS cell FROM part")
def cell_of_each_member(t):
    """The cell of the partition by three predicates that a member is in."""
    tests = (F.col("p_size") < 10, F.col("p_retailprice") > 1000, F.col("p_brand").like("%1"))
    return t.part.select("p_partkey", sum((x.cast("int") * 2 ** (2 - i) for i, x in enumerate(tests)), F.lit(0)).alias("cell"))


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) AS member FROM orders")
def membership_flag(t):
    """The indicator of a set as a column: a semi-join that keeps what has no partner."""
    some = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("member", F.lit(True))
    return t.orders.select("o_orderkey").join(some, "o_orderkey", "left").withColumn("member", F.coalesce("member", F.lit(False)))


@query("SELECT o_custkey, array_to_string(list_reverse(list(s ORDER BY o_orderkey DESC)), ',') AS sums FROM (SELECT o_custkey, o_orderkey, sum(CASE o_orderstatus WHEN 'O' THEN 1 ELSE 2 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS s FROM orders) GROUP BY o_custkey")
def right_to_left_sums(t):
    """A stateful map from the right end of each customer's list of orders."""
    lists = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("l"))
    codes = F.transform("l", lambda x: F.when(x["o_orderstatus"] == "O", 1).otherwise(2))
    made = X.map_accum_right(codes, F.lit(0), lambda x, state: (state + x, state + x))
    return lists.select("o_custkey", F.array_join(F.transform(made["items"], lambda x: x.cast("string")), ",").alias("sums"))


@query("SELECT l_orderkey, l_linenumber, exp(CASE WHEN l_tax = 0 THEN '-Infinity'::DOUBLE ELSE l_tax::DOUBLE END) AS x FROM lineitem")
def extended_exponential(t):
    x = F.when(F.col("l_tax") == 0, F.lit(float("-inf"))).otherwise(F.col("l_tax").cast("double"))
    return t.lineitem.select("l_orderkey", "l_linenumber", X.extended_exp(x).alias("x"))


@query("SELECT n_nationkey AS b, n_nationkey + 1 AS h0, 3 + n_nationkey AS h1, 3 * n_nationkey AS h2, (3::HUGEINT ** n_nationkey)::DOUBLE AS h3 FROM nation")
def hyperoperations(t):
    a, b = F.lit(3).cast("long"), F.col("n_nationkey")
    return t.nation.select(b.alias("b"), *[X.hyperoperation(n, a, b).alias(f"h{n}") for n in range(3)], X.hyperoperation(3, a, b).cast("double").alias("h3"))


@query("SELECT p_partkey, (p_size * 2 * 4 + p_size * 3 * 1 + 1 * 5 * 4 + 1 * 3 * 7 + p_partkey * 5 * 1 + p_partkey * 2 * 7)::BIGINT AS x FROM part")
def matrix_permanent(t):
    """The permanent of a matrix of three rows for each part."""
    long = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("long")
    rows = F.array(*[F.array(*[long(x) for x in row]) for row in (("p_size", 1, "p_partkey"), (5, 2, 3), (7, 1, 4))])
    return t.part.select("p_partkey", X.permanent(rows, 3).alias("x"))


@query("SELECT n_nationkey, n_name || ',' || n_regionkey || ',end' AS x, concat(n_regionkey * 2, ',', n_nationkey + 1) AS y FROM nation")
def lists_extended_and_applied(t):
    """One item more at a list's end, and functions applied place by place."""
    s = lambda x: F.col(x).cast("string")
    made = X.apply_each([lambda x: x * 2, lambda x: x + 1], F.array("n_regionkey", "n_nationkey"))
    return t.nation.select("n_nationkey", F.array_join(X.snoc(F.array(s("n_name"), s("n_regionkey")), F.lit("end")), ",").alias("x"), F.array_join(F.transform(made, lambda x: x.cast("string")), ",").alias("y"))


@query("SELECT p_partkey AS seq, p_partkey AS nat, 7 AS const, ['a', 'b', 'c'][(p_partkey % 3 + 1)::INT] AS cyc FROM part")
def endless_sequences(t):
    """The naturals, a constant and a cycle at the places of the parts' keys; as streams they are in streaming.endless."""
    names, seq = F.array(*[F.lit(x) for x in "abc"]), F.col("p_partkey")
    return t.part.select(seq.alias("seq"), seq.alias("nat"), F.lit(7).alias("const"), F.get(names, (seq % 3).cast("int")).alias("cyc"))


@query("SELECT regexp_extract(props, '\"([a-z_]+)\": ?', 1) AS k, count(*) AS n FROM events WHERE regexp_matches(props, '\"([a-z_]+)\": ?') GROUP BY 1")
def keys_by_pattern(t):
    """Lines that fit a pattern, as a map from their key to a number."""
    pattern = '"([a-z_]+)": ?'
    return t.events.where(F.col("props").rlike(pattern)).groupBy(F.regexp_extract("props", pattern, 1).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS removed, count(*) FILTER (a <> b) AS changed FROM (SELECT l_partkey, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) FULL JOIN (SELECT l_partkey, count(*) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (l_partkey)")
def added_removed_changed(t):
    a, b = (t.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count(F.lit(1)).alias(name)) for flag, name in (("A", "a"), ("R", "b")))
    return a.join(b, "l_partkey", "full").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


@query("SELECT p_type, count(*) AS n FROM part WHERE starts_with(p_type, (SELECT left(min(p_type), 3) FROM part)) GROUP BY p_type")
def counted_by_prefix(t):
    """Names with a prefix, counted; the prefix is the first name's."""
    first = t.part.agg(F.left(F.min("p_type"), F.lit(3)).alias("prefix"))
    return t.part.join(F.broadcast(first), F.startswith("p_type", F.col("prefix"))).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, sum(CASE WHEN isfinite(x) THEN x END) AS total, count(*) FILTER (x IS NULL) AS failed FROM (SELECT event_type, try_cast(event_type || '' AS DOUBLE) AS x FROM events UNION ALL SELECT event_type, value::DOUBLE FROM events) GROUP BY event_type")
def fold_with_failures(t):
    """A fold that collects what fails instead of stopping: texts that are no numbers are counted."""
    rows = t.events.select("event_type", F.expr("try_cast(event_type AS DOUBLE)").alias("x")).unionAll(t.events.select("event_type", F.col("value").cast("double").alias("x")))
    return rows.groupBy("event_type").agg(F.sum("x").alias("total"), F.count_if(F.col("x").isNull()).alias("failed"))


@query("SELECT c_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) RIGHT JOIN customer ON o_custkey = c_custkey", origin="driver")
def right_join_counts(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(t.customer.select("c_custkey"), "c_custkey", "right")


@query("SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts AND b.event_type = 'purchase' GROUP BY 1", origin="driver")
def interval_join_counts(t):
    """Purchases of the same user within the hour before: a join on the user and an interval, by cells of an hour."""
    hour = lambda x: F.floor(F.unix_micros(x.cast("timestamp")) / 3_600_000_000)
    a = t.events.select("event_id", "user_id", F.col("ts").alias("at"), F.explode(F.array(hour(F.col("ts")) - 1, hour(F.col("ts")))).alias("cell"))
    b = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("then"), hour(F.col("ts")).alias("cell"))
    hits = a.join(b, ["user_id", "cell"]).where(F.col("then").between(F.col("at") - F.expr("INTERVAL 1 HOUR"), F.col("at"))).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return t.events.select("event_id").join(hits, "event_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())", origin="driver")
def grouping_sets_counts(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return t.orders.groupingSets([[p], [s], []], p, s).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, min(l_quantity) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY l_returnflag) AS most FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_quantity)) WHERE n = most GROUP BY 1", origin="driver")
def modes(t):
    """The most frequent value, the least one of several."""
    return t.lineitem.groupBy("l_returnflag").agg(F.mode("l_quantity", True).alias("mode"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS recent, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following FROM orders", origin="driver")
def range_frame_and_lead(t):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    w = Window.partitionBy("o_custkey").orderBy(day).rangeBetween(-30 * 86_400_000_000, 0)
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(w).alias("recent"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("following"))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s", origin="driver")
def sliding_windows(t):
    """Windows of two hours, one beginning each hour."""
    w = F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour")
    return t.events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, last_day(o_orderdate::DATE) AS e, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS d FROM orders", origin="driver")
def date_parts(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.last_day(d).alias("e"), F.datediff(d, F.lit("1990-01-01").cast("date")).cast("long").alias("d"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", origin="driver")
def temporary_view(t):
    """A view for one statement: named in it, and dropped when it has been planned."""
    return t.spark.sql("SELECT n_regionkey, count(*) AS n FROM {nations} GROUP BY n_regionkey", nations=t.nation)


def _round_trip(t, kind, **options):
    path = shared_path(t.spark, kind)
    rows = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    rows.write.format(kind).options(**options).save(path)
    return t.spark.read.schema(rows.schema).format(kind).options(**options).load(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation", origin="driver")
def csv_round_trip(t):
    return _round_trip(t, "csv", header="true")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation", origin="driver")
def orc_round_trip(t):
    return _round_trip(t, "orc")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1", origin="driver")
def join_strategies(t):
    """One join by sorting, by hashing and by broadcast: the same rows, put together by their agreement."""
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    made = [t.lineitem.join(o.hint(h), "l_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")) for h in ("merge", "shuffle_hash", "broadcast")]
    return made[0].intersect(made[1]).intersect(made[2])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_type_counts(t):
    """Counts by a stream in complete mode, the sink in the shared folder."""
    path = shared_path(t.spark, "types")
    t.events.select("event_type").write.parquet(path)
    s = t.spark.readStream.schema("event_type string").parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return seq.run_to_end(s, "types-counted", "complete")
