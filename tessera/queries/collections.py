"""Bags and sets over the tables."""

from pyspark.sql import functions as F

from ..operators import bags
from ..registry import query


@query("SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total, count(*) AS n, arg_max(props, (ts, event_id)) AS last_props FROM events GROUP BY event_type")
def slice_event_totals(t):
    """Scan, group, sum, last writer wins, sort."""
    return t.events.groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"), F.max_by("props", F.struct("ts", "event_id")).alias("last_props")).orderBy("event_type")


@query("SELECT l_quantity * 2 AS x FROM lineitem")
def bag_map(t):
    return t.lineitem.select((F.col("l_quantity") * 2).alias("x"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def bag_filter(t):
    return t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber")


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM benchmark) GROUP BY word")
def bag_bind(t):
    words = bags.bind(t.benchmark, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), "word")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def bag_sum(t):
    both = t.customer.select(F.col("c_nationkey").alias("k")).unionAll(t.supplier.select("s_nationkey"))
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_TWO = "a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) * 20 AS n FROM supplier GROUP BY 1)"


def _two(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"))
    return a, t.supplier.select(F.col("s_nationkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i")).select("k")


@query(f"WITH {_TWO}, c AS (SELECT coalesce(a.k, b.k) AS k, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM a FULL JOIN b ON a.k = b.k) SELECT k FROM c, range(100000) r(i) WHERE i < n")
def bag_union_max(t):
    return bags.union_max(*_two(t))


@query(f"WITH {_TWO}, c AS (SELECT a.k, least(a.n, b.n) AS n FROM a JOIN b ON a.k = b.k) SELECT k FROM c, range(100000) r(i) WHERE i < n")
def bag_intersection(t):
    return bags.intersect_min(*_two(t))


@query(f"WITH {_TWO}, c AS (SELECT a.k, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON a.k = b.k) SELECT k FROM c, range(100000) r(i) WHERE i < n")
def bag_difference(t):
    return bags.difference(*_two(t))


@query("SELECT DISTINCT l_quantity % 7 AS x FROM lineitem")
def set_image(t):
    return t.lineitem.select((F.col("l_quantity") % 7).alias("x")).distinct()


@query("SELECT r_name, n_name FROM region, nation")
def set_product(t):
    """A product of two sets: the larger side streams past the smaller one, which has five rows here."""
    return t.nation.select("n_name").crossJoin(t.region.select("r_name")).select("r_name", "n_name")


@query("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def set_dependent_product(t):
    return t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name")


@query("SELECT DISTINCT (l_orderkey + i) % 100 AS x FROM lineitem, (VALUES (0), (1), (2)) v(i)")
def set_flat_map_distinct(t):
    return t.lineitem.select(F.explode(F.array(*[(F.col("l_orderkey") + i) % 100 for i in range(3)])).alias("x")).distinct()


@query("SELECT m AS mask, array_to_string(list_sort(list_filter([r_name FOR r_name IN (SELECT list(r_name ORDER BY r_name) FROM region)], lambda x, i: (m >> (i - 1)) & 1 = 1)), ',') AS members FROM range(32) r(m)")
def set_powerset(t):
    return bags.powerset(t.region, "r_name").select("mask", F.array_join("subset", ",").alias("members"))


@query("SELECT array_to_string(list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 1), ',') AS lefts, array_to_string(list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 0), ',') AS rights FROM range(32) r(m), (SELECT list(r_name ORDER BY r_name) AS l FROM region)")
def bag_antidiagonal(t):
    return bags.antidiagonal(t.region, "r_name").select(F.array_join("left", ",").alias("lefts"), F.array_join("right", ",").alias("rights"))


@query("SELECT DISTINCT list_sum(list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 1))::BIGINT AS total FROM (SELECT list(k) AS l FROM (SELECT DISTINCT r_regionkey * r_regionkey + 1 AS k FROM region)), range(32) r(m) WHERE m > 0 UNION SELECT 0")
def set_subset_sums(t):
    return bags.subset_sums(t.region.select((F.col("r_regionkey") * F.col("r_regionkey") + 1).cast("long").alias("k")), "k")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def bag_dedup(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def bag_duplicates(t):
    return t.lineitem.groupBy("l_suppkey", "l_partkey").count().where("count > 1").drop("count")


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
def set_difference(t):
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.where("l_quantity = 50").select("l_partkey"))


@query("(SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 50 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 1) UNION (SELECT l_partkey FROM lineitem WHERE l_quantity = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def set_symmetric_difference(t):
    return bags.symmetric_difference(*[t.lineitem.where(F.col("l_quantity") == x).select(F.col("l_partkey").alias("k")) for x in (50, 1)])


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20")
def set_big_intersection(t):
    key = F.col("l_partkey").alias("k")
    return bags.big_intersection([t.lineitem.where("l_quantity < 10").select(key), t.lineitem.where("l_quantity > 40").select(key), t.part.where("p_size < 20").select(F.col("p_partkey").alias("k"))])


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 3 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def set_big_union(t):
    return bags.big_union([t.lineitem.where("l_quantity < 3").select(F.col("l_partkey").alias("k")), t.part.where("p_size < 5").select("p_partkey")])


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def set_disjoint_union(t):
    """Sets that are known to be disjoint need no distinct."""
    return t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k")).unionAll(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"))


@query("SELECT n_nationkey AS k, 'left' AS side FROM nation UNION ALL SELECT r_regionkey, 'right' FROM region")
def bag_tagged_union(t):
    return bags.tagged_union(t.nation.select(F.col("n_nationkey").alias("k")), t.region.select(F.col("r_regionkey").alias("k")))


@query("SELECT n_regionkey AS k FROM nation UNION SELECT NULL")
def set_insert_none(t):
    return bags.insert(t.nation.select(F.col("n_regionkey").alias("k")).distinct(), k=None)


@query("SELECT DISTINCT CASE WHEN l_quantity > 25 THEN l_linenumber END AS k FROM lineitem WHERE l_quantity > 25")
def set_erase_none(t):
    return t.lineitem.select(F.when(F.col("l_quantity") > 25, F.col("l_linenumber")).alias("k")).distinct().dropna()


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IS DISTINCT FROM 7")
def set_erase(t):
    return bags.erase(t.nation.select("n_nationkey"), "n_nationkey", 7)


@query("SELECT n_name FROM nation WHERE n_nationkey = 3")
def find_unique(t):
    return bags.unique_match(t.nation, F.col("n_nationkey") == 3).select("n_name")


@query("SELECT a, b, c, count(l_orderkey) AS n FROM (VALUES (FALSE), (TRUE)) x(a), (VALUES (FALSE), (TRUE)) y(b), (VALUES (FALSE), (TRUE)) z(c) LEFT JOIN lineitem ON (l_quantity > 25) = a AND (l_discount > 0.05) = b AND (l_quantity < 10) = c GROUP BY a, b, c")
def partition_by_predicates(t):
    return bags.partition_cells(t.lineitem, {"a": F.col("l_quantity") > 25, "b": F.col("l_discount") > 0.05, "c": F.col("l_quantity") < 10})


@query("SELECT DISTINCT CAST(10 / nullif(l_linenumber - 3, 0) AS DOUBLE) AS x FROM lineitem WHERE l_linenumber <> 3")
def partial_image(t):
    return bags.partial_image(t.lineitem, F.when(F.col("l_linenumber") != 3, F.lit(10.0) / (F.col("l_linenumber") - 3)), "x")


@query("SELECT p_size + 1 AS x FROM part WHERE (SELECT count(*) FROM part WHERE p_size IS NULL) = 0")
def traverse_all(t):
    return bags.traverse(t.part, F.col("p_size") + 1, "x")


@query("SELECT CASE WHEN p_size IN (1, 2, 3) THEN p_size * 10 ELSE -p_size END AS x, p_partkey FROM part")
def piecewise(t):
    return t.part.select(F.when(F.col("p_size").isin(1, 2, 3), F.col("p_size") * 10).otherwise(-F.col("p_size")).alias("x"), "p_partkey")


@query("SELECT n_name, r FROM (SELECT n_name, unnest(range(0, n_regionkey)) AS r FROM nation)")
def replicate(t):
    """n copies of a row."""
    return t.nation.where("n_regionkey > 0").select("n_name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_regionkey").cast("long") - 1)).alias("r"))


@query("SELECT k, count(*) AS n FROM (SELECT l_linenumber AS k FROM lineitem) GROUP BY k")
def bag_to_counts(t):
    return t.lineitem.groupBy(F.col("l_linenumber").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey AS k FROM nation")
def counts_to_bag(t):
    counts = t.nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return bags.repeated(counts, F.col("n"), ["k"])


@query("WITH c AS (SELECT l_suppkey % 3 AS p, count(*) AS n FROM lineitem GROUP BY 1) SELECT max(n) - min(n) <= 1 AS equitable FROM c")
def is_equipartition(t):
    sizes = t.lineitem.groupBy((F.col("l_suppkey") % 3).alias("p")).count()
    return sizes.agg(F.coalesce(F.max("count") - F.min("count") <= 1, F.lit(True)).alias("equitable"))


@query("SELECT p, count(*) AS n FROM (SELECT ntile(4) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation) GROUP BY p")
def equipartition(t):
    from pyspark.sql import Window

    return t.nation.select(F.ntile(4).over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (x + y) AS value, count(*) AS n FROM (SELECT DISTINCT p_size AS x FROM part), (SELECT DISTINCT n_nationkey AS y FROM nation) GROUP BY 1")
def additive_convolution(t):
    from ..operators.relations import convolution

    return convolution(t.part.select("p_size"), t.nation.select("n_nationkey"), lambda x, y: x + y)


@query("SELECT sum(n * n)::BIGINT AS energy FROM (SELECT x + y AS v, count(*) AS n FROM (SELECT DISTINCT p_size AS x FROM part), (SELECT DISTINCT n_nationkey AS y FROM nation) GROUP BY 1)")
def additive_energy(t):
    from ..operators.relations import convolution

    return convolution(t.part.select("p_size"), t.nation.select("n_nationkey"), lambda x, y: x + y).agg(F.sum(F.col("n") * F.col("n")).alias("energy"))
