"""User-defined folds, rewrites, and (origin "driver") Spark built-ins exposed for the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.relations import asof
from ..plans import folds, laws
from ..registry import query


@query("SELECT CAST(sum(l_quantity) AS DOUBLE) AS state FROM lineitem")
def fold_partitions(t):
    return folds.fold_partitions(t.lineitem.select("l_quantity"), 0.0, lambda s, b: s + float(b["l_quantity"].sum()), F.sum)


@query("SELECT CASE WHEN n_nationkey <> 0 THEN 100 // n_nationkey END AS value, n_nationkey = 0 AS failed FROM nation")
def guarded_map(t):
    """Rows whose function fails keep their error; the others their value."""

    def inverse(b):
        if (b["n_nationkey"] == 0).any():
            raise ZeroDivisionError("n_nationkey")
        return 100 // b["n_nationkey"]

    return folds.guarded_map(t.nation.select("n_nationkey"), inverse, "int").select("value", F.col("error").isNotNull().alias("failed"))


@query("SELECT o_orderstatus, CAST(sum(l_quantity) AS DOUBLE) AS l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def eager_aggregation(t):
    return laws.eager_sum(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), t.orders, "o_orderkey", "l_quantity", ["o_orderstatus"])


@query("SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey < 3")
def double_difference(t):
    return laws.double_difference(t.nation.select(F.col("n_regionkey").alias("k")), t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("k")))


@query("SELECT count(*) FILTER (l_quantity > 25) AS yes, count(*) FILTER (NOT l_quantity > 25) AS no FROM lineitem")
def complement_count(t):
    return laws.count_complement(t.lineitem, F.col("l_quantity") > 25)


@query("SELECT p_partkey AS k FROM part EXCEPT (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 UNION SELECT p_partkey FROM part WHERE p_size < 10)")
def difference_of_union(t):
    return laws.difference_of_union(t.part.select(F.col("p_partkey").alias("k")), [t.lineitem.where("l_quantity = 50").select("l_partkey"), t.part.where("p_size < 10").select("p_partkey")])


@query("SELECT k, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS k, 1 AS n FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY k")
def union_of_sums(t):
    one = F.lit(1).cast("long").alias("n")
    return laws.sum_over_union([t.customer.select(F.col("c_nationkey").alias("k"), one), t.supplier.select(F.col("s_nationkey").alias("k"), one)], ["k"], "n")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL", origin="driver")
def pricing_summary(t):
    return t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, l_returnflag, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY CUBE (o_orderpriority, l_returnflag)", origin="driver")
def cube_counts(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).cube("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_name)", origin="driver")
def rollup_counts(t):
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).rollup("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", origin="driver")
def left_join_counts(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT coalesce(o_custkey, c_custkey) AS k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT o_custkey, count(*) AS a FROM orders GROUP BY 1) FULL JOIN (SELECT c_custkey, count(*) AS b FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON o_custkey = c_custkey", origin="driver")
def full_join_counts(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = t.customer.where("c_acctbal < 0").groupBy(F.col("c_custkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


@query("SELECT e.event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts", origin="driver")
def asof_join(t):
    right = t.events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("bought")).agg(F.max("value").alias("last_purchase"))
    return asof(t.events.select("event_id", "user_id", "ts"), right, "user_id", "ts", "bought").select("event_id", "last_purchase")


@query("SELECT event_type, median(value) AS med, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1", origin="driver")
def quantiles(t):
    return t.events.groupBy("event_type").agg(F.median("value").alias("med"), F.percentile("value", F.lit(0.9)).alias("p90"))


@query(origin="driver")
def approximate_distinct(t):
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)", origin="driver")
def ranks_and_lags(t):
    w = Window.partitionBy("user_id").orderBy("event_type")
    return t.events.select("event_id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL", origin="driver")
def tumbling_windows(t):
    return t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY user_id, s", origin="driver")
def session_windows(t):
    e = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "1 day")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n")).select("user_id", "first_ts", "n")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", origin="driver")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT l_suppkey, CAST(sum(l_quantity) FILTER (l_linestatus = 'F') AS DOUBLE) AS f, CAST(sum(l_quantity) FILTER (l_linestatus = 'O') AS DOUBLE) AS o FROM lineitem GROUP BY 1", origin="driver")
def pivot_totals(t):
    return t.lineitem.groupBy("l_suppkey").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity")).withColumnsRenamed({"F": "f", "O": "o"})
