"""Chains, exports in order, closures of sets, small linear systems, exact roots and table functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..operators import graphs as G
from ..plans import folds, linear
from ..registry import query
from .graphs import _EDGES, _edges

_DIVIDES = "s AS (SELECT DISTINCT p_size AS x FROM part WHERE p_size > 0), e AS (SELECT a.x AS src, b.x AS dst FROM s a JOIN s b ON a.x < b.x AND b.x % a.x = 0)"


@query(f"WITH RECURSIVE {_DIVIDES}, r(id, h) AS (SELECT x, 1 FROM s UNION SELECT e.dst, r.h + 1 FROM r JOIN e ON r.id = e.src) SELECT max(h)::BIGINT AS height FROM r")
def chain_height(t):
    """The longest chain of the parts' sizes, ordered by divisibility."""
    sizes = t.part.where("p_size > 0").select(F.col("p_size").alias("x")).distinct()
    # the multiples of a size up to the greatest one, rather than all pairs
    top = sizes.agg(F.max("x").alias("top"))
    multiples = sizes.join(F.broadcast(top), F.lit(True)).where("2 * x <= top").select(F.col("x").alias("src"), F.explode(F.sequence(2 * F.col("x"), F.col("top"), F.col("x"))).alias("x"))
    return G.height(multiples.join(sizes, "x").select("src", F.col("x").alias("dst")))


@query(f"WITH RECURSIVE {_EDGES}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r(id, level) AS (SELECT id, 0 FROM v UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.id), l AS (SELECT id, max(level) AS level FROM r GROUP BY id) SELECT pos::BIGINT AS pos, pos || ' def ' || l.id || coalesce(' := ' || e.dst, '') AS line FROM (SELECT id, row_number() OVER (ORDER BY level, id) - 1 AS pos FROM l) l LEFT JOIN e ON e.src = l.id")
def dependency_ordered_export(t):
    """Each order as a line of text, once, behind the order that it needs."""
    edges = _edges(t)
    listed = G.in_dependency_order(edges).join(edges.withColumnRenamed("src", "id"), "id", "left")
    return listed.select("pos", F.concat(F.col("pos").cast("string"), F.lit(" def "), F.col("id").cast("string"), F.coalesce(F.concat(F.lit(" := "), F.col("dst").cast("string")), F.lit(""))).alias("line"))


@query("WITH RECURSIVE b AS (SELECT bit_or(1::BIGINT << n_nationkey) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_suppkey % 7), r(m) AS (SELECT m FROM b UNION SELECT r.m & b.m FROM r JOIN b ON r.m <> b.m) SELECT array_to_string(list_filter(range(25), lambda i: (m >> i) & 1 = 1), ',') AS members FROM r")
def intersection_closure(t):
    """All intersections of seven sets of nations, those of the suppliers with equal rests of their keys."""
    sets = t.supplier.groupBy(F.col("s_suppkey") % 7).agg(F.array_sort(F.collect_set("s_nationkey")).alias("members"))
    return G.intersections(sets).select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT s_suppkey, 3.0::DOUBLE / (2 * s_nationkey + 1) AS x, (7.0::DOUBLE * s_nationkey + 2) / (2 * s_nationkey + 1) AS y FROM supplier")
def linear_systems(t):
    """(n + 1) x + y = 5 and x + 2 y = 7 for each supplier of nation n, by elimination."""
    n = F.col("s_nationkey").cast("double")
    rows = t.supplier.select("s_suppkey", F.inline(F.array(F.struct(F.lit(0).alias("i"), (n + 1).alias("a"), F.lit(1.0).alias("b"), F.lit(5.0).alias("c")), F.struct(F.lit(1).alias("i"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(7.0).alias("c")))))
    solved = linear.eliminated(rows, "s_suppkey", "i", ["a", "b", "c"])
    return solved.groupBy("s_suppkey").agg(F.max(F.when(F.col("row") == 0, F.get("values", F.lit(2)))).alias("x"), F.max(F.when(F.col("row") == 1, F.get("values", F.lit(2)))).alias("y"))


@query("SELECT n_regionkey, min(n_nationkey - 12) <= 0 AND max(n_nationkey - 12) >= 0 AS feasible FROM nation GROUP BY n_regionkey")
def positive_combination(t):
    """Whether a sum of a region's nations' keys, each less 12, with weights of 0 or more can be 0."""
    rows = t.nation.select("n_regionkey", "n_nationkey", (F.col("n_nationkey") - 12).cast("double").alias("x"))
    return linear.positive_combinations(rows, "n_regionkey", "n_nationkey", ["x"]).select("n_regionkey", F.col("weights").isNotNull().alias("feasible"))


@query("SELECT p_partkey, floor(sqrt(p_size // gcd(p_size::BIGINT, p_partkey)))::BIGINT AS num, floor(sqrt(p_partkey // gcd(p_size::BIGINT, p_partkey)))::BIGINT AS den FROM part")
def rational_square_roots(t):
    """The root of an exact fraction, size over key in least terms: those of its two numbers, rounded down."""
    # Euclid's steps; numbers below 2^63 take fewer than 92
    pair = F.struct(F.col("p_size").cast("long").alias("a"), F.col("p_partkey").cast("long").alias("b"))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % s["b"]).alias("b")))["a"]
    rows = t.part.select("p_partkey", F.col("p_size").cast("long").alias("n"), g.alias("g"))
    return rows.select("p_partkey", M.int_sqrt(F.expr("n div g")).cast("long").alias("num"), M.int_sqrt(F.expr("p_partkey div g")).cast("long").alias("den"))


@query("SELECT user_id, list_reduce(list((event_id % 1000)::BIGINT ORDER BY ts, event_id), lambda a, x: (a * 31 + x) % 1000003) AS state FROM events GROUP BY user_id")
def fold_in_sequence(t):
    """A fold whose result depends on the order, over each user's events one after another."""
    rows = t.events.select("user_id", "ts", "event_id", (F.col("event_id") % 1000).alias("x"))
    return folds.fold_in_order(rows, "user_id", ["ts", "event_id"], "x", 0, lambda a, x: (a * 31 + x) % 1000003)


@query("SELECT count(DISTINCT p_size < 10) AS one, count(DISTINCT (p_size < 10, p_retailprice > 1000)) AS two, count(DISTINCT (p_size < 10, p_retailprice > 1000, p_brand)) AS three FROM part")
def refined_partitions(t):
    """The cells of the partitions by the first, the first two and all three of some tests, each finer than the one before."""
    tests = [(F.col("p_size") < 10).alias("a"), (F.col("p_retailprice") > 1000).alias("b"), F.col("p_brand").alias("c")]
    return t.part.agg(*[F.count_distinct(F.struct(*tests[: i + 1])).alias(n) for i, n in enumerate(("one", "two", "three"))])


@query("SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
def set_to_list(t):
    """A set as a list without repeats, in order."""
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


class Divisors:
    """A table function: the divisors of a number, in order."""

    def eval(self, n: int):
        for x in range(1, (n or 0) + 1):
            if n % x == 0:
                yield (x,)


@query("SELECT s AS p_size, d AS divisor FROM (SELECT s, unnest(list_filter(range(1, s + 1), lambda d: s % d = 0)) AS d FROM (SELECT DISTINCT p_size AS s FROM part))", origin="driver")
def table_function(t):
    """A user's table function, joined laterally to the parts' sizes."""
    t.spark.udtf.register("tessera_divisors", F.udtf(Divisors, returnType="divisor: int"))
    t.part.select("p_size").distinct().createOrReplaceTempView("tessera_sizes")
    return t.spark.sql("SELECT p_size, divisor FROM tessera_sizes, LATERAL tessera_divisors(p_size)")


@query("SELECT count(*) FILTER (gap > 3600) AS stalls, max(gap)::BIGINT AS longest FROM (SELECT epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)")
def stalls_between_elements(t):
    """Whether each user's sequence goes on: the waits of more than an hour, and the longest one."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(gap.alias("gap")).agg(F.count_if(F.col("gap") > 3600).alias("stalls"), F.max("gap").cast("long").alias("longest"))
