"""Order-dependent operators, sorting, limits and comparison."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators.relations import ordinal
from ..registry import query

_ROWS = Window.unboundedPreceding


@query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))), ',') AS roles FROM conversations")
def accumulate(t):
    """Running union."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(_ROWS, 0)
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(F.collect_set("role").over(w)), ",").alias("roles"))


@query("SELECT conv_id, turn, CAST(bit_and(CAST(length(text) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bits FROM conversations")
def dissipate(t):
    """Running intersection, of sets as bit masks."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(_ROWS, 0)
    return t.conversations.select("conv_id", "turn", F.bit_and(F.length("text").cast("long")).over(w).alias("bits"))


@query("SELECT n_regionkey, n_nationkey, array_to_string(list(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING), ',') AS prefix, array_to_string(list(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), ',') AS suffix FROM nation")
def inits_and_tails(t):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    text = lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ",")
    return t.nation.select("n_regionkey", "n_nationkey", text(F.collect_list("n_nationkey").over(w.rowsBetween(_ROWS, 0))).alias("prefix"), text(F.collect_list("n_nationkey").over(w.rowsBetween(0, Window.unboundedFollowing))).alias("suffix"))


@query("SELECT event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM events")
def running_count(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(_ROWS, -1)
    return t.events.select("event_id", F.count_if(F.col("event_type") == "purchase").over(w).alias("n"))


@query("SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS place FROM nation")
def enumerate_by_least(t):
    return t.nation.select("n_regionkey", "n_name", (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")) - 1).cast("long").alias("place"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier")
def rank_bijection(t):
    """Each row's place in the whole order, without a window over all rows."""
    return ordinal(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").select("s_suppkey", "pos")


@query("SELECT p_size AS x, lead(p_size) OVER (ORDER BY p_size) AS successor FROM (SELECT DISTINCT p_size FROM part)")
def covers(t):
    """Immediate successors among the distinct values: each joined to the one at the next place."""
    placed = ordinal(t.part.select(F.col("p_size").alias("x")).distinct(), "x")
    following = placed.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("successor"))
    return placed.join(following, "pos", "left").select("x", "successor")


@query("SELECT user_id, max(run) AS longest FROM (SELECT user_id, count(*) AS run FROM (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, g) GROUP BY user_id")
def longest_rising_run(t):
    """The longest run of rising neighbours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    brk = t.events.withColumn("brk", F.when(F.col("value") > F.lag("value").over(w), 0).otherwise(1))
    return brk.withColumn("g", F.sum("brk").over(w)).groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("run")).groupBy("user_id").agg(F.max("run").alias("longest"))


@query("SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN pos END) AS first_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) GROUP BY user_id")
def first_that_fits(t):
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return t.events.withColumn("pos", pos).groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("pos"))).alias("first_at"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def take_first(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def drop_first(t):
    return t.nation.select("n_nationkey").orderBy("n_nationkey").offset(20)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 4")
def take_last(t):
    return t.nation.select("n_nationkey").orderBy(F.desc("n_nationkey")).limit(4)


@query("SELECT p_name FROM (SELECT DISTINCT p_name FROM part) ORDER BY length(p_name), p_name LIMIT 15")
def shortlex_order(t):
    return t.part.select("p_name").distinct().orderBy(*S.shortlex(F.col("p_name"))).limit(15)


@query("SELECT o_orderkey, CASE WHEN o_totalprice = 100000 THEN 0 WHEN o_totalprice < 100000 THEN -1 ELSE 1 END AS c FROM orders")
def three_way_compare(t):
    return t.orders.select("o_orderkey", S.compare(F.col("o_totalprice"), F.lit(100000.0)).alias("c"))


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND (a.n_regionkey, a.n_name) < (b.n_regionkey, b.n_name)")
def lexicographic_pairs(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    less = F.struct("a.n_regionkey", "a.n_name") < F.struct("b.n_regionkey", "b.n_name")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & less).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("SELECT l_shipmode_rank, l_orderkey FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS l_shipmode_rank FROM lineitem) WHERE l_shipmode_rank <= 2")
def top_two_per_supplier(t):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t.lineitem.select("l_orderkey", F.row_number().over(w).cast("long").alias("l_shipmode_rank")).where("l_shipmode_rank <= 2")


@query("SELECT text, lang, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def marked_duplicates(t):
    """Sorted insertion that marks later duplicates."""
    d = t.documents.select("text", "lang", "doc_id")
    return d.withColumn("duplicate", F.row_number().over(Window.partitionBy(F.md5("text")).orderBy("doc_id")) > 1)


@query("SELECT p_size AS bound FROM (SELECT DISTINCT p_size FROM part) WHERE p_size >= (SELECT max(n_nationkey) FROM nation)")
def upper_bounds(t):
    top = t.nation.agg(F.max("n_nationkey").alias("m"))
    return t.part.select(F.col("p_size").alias("bound")).distinct().join(F.broadcast(top), F.col("bound") >= F.col("m")).select("bound")


@query("SELECT l_quantity AS x FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 UNION ALL SELECT l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 11 UNION ALL SELECT l_quantity FROM lineitem WHERE l_quantity BETWEEN 3 AND 4 UNION ALL SELECT l_quantity FROM lineitem WHERE l_quantity < 2 UNION ALL SELECT l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 13")
def intervals(t):
    """Half-open, closed, unbounded and open intervals: all are pushed to the scan."""
    q = F.col("l_quantity")
    parts = [(q >= 10) & (q < 12), (q > 10) & (q <= 11), q.between(3, 4), q < 2, (q > 10) & (q < 13)]
    out = None
    for p in parts:
        some = t.lineitem.where(p).select(q.alias("x"))
        out = some if out is None else out.unionAll(some)
    return out


@query("SELECT lang, array_to_string(list(doc_id ORDER BY length(text), doc_id)[:3], ',') AS shortest FROM documents GROUP BY lang")
def sorted_prefix_per_group(t):
    """The three shortest of each language: ranked within the language, only three rows of each are gathered."""
    w = Window.partitionBy("lang").orderBy(F.length("text"), "doc_id")
    r = t.documents.select("lang", "doc_id", F.row_number().over(w).alias("r")).where("r <= 3")
    return r.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("shortest"))
