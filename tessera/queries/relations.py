"""Joins and relations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relations as rel
from ..registry import query


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) SELECT pos, n_name, s_suppkey FROM a JOIN b USING (pos)")
def positional_join(t):
    return rel.positional_zip(t.nation.select("n_name"), t.supplier.select("s_suppkey"), "n_name", "s_suppkey")


@query("SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 2, 3)) GROUP BY 1 HAVING count(*) = 3")
def division(t):
    """Suppliers that appear at each of the line numbers 1, 2 and 3."""
    wanted = t.lineitem.where("l_linenumber IN (1, 2, 3)").select("l_linenumber").distinct()
    return rel.divide(t.lineitem, "l_linenumber", "l_suppkey", wanted, t.lineitem.select("l_suppkey"))


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def division_by_nothing(t):
    return rel.divide(t.lineitem, "l_linenumber", "l_suppkey", t.lineitem.where("l_linenumber > 100").select("l_linenumber"), t.lineitem.select("l_suppkey"))


@query("SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def dependency_violations(t):
    return rel.functional(t.lineitem, "l_partkey", "l_suppkey").withColumnRenamed("l_partkey", "k")


@query("SELECT count(*) = 0 AS key FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def key_check(t):
    bad = t.orders.groupBy("o_orderkey").count().where("count > 1")
    return bad.agg((F.count(F.lit(1)) == 0).alias("key"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_total(t):
    return rel.uncovered(t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
def first_order_formula(t):
    rich = t.supplier.where("s_acctbal > 5000")
    return t.nation.join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").join(t.customer.where("c_acctbal > 9900"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select("n_nationkey")


_F = "f AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), g AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"


def _fg(t):
    f, g = (t.lineitem.where(F.col("l_returnflag") == x).groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("v")) for x in "RA")
    return f, g


@query(f"WITH {_F} SELECT k FROM f FULL JOIN g USING (k) WHERE coalesce(f.v, 0) <> coalesce(g.v, 0)")
def differing_keys(t):
    return rel.differing_keys(*_fg(t), "k", "v")


@query("SELECT s_suppkey AS k, coalesce(v, 0) AS v FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS v FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 GROUP BY 1) ON s_suppkey = l_suppkey")
def lookup_or_zero(t):
    f = t.lineitem.where("l_quantity > 49 AND l_discount > 0.09").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return rel.lookup_or_zero(t.supplier.select(F.col("s_suppkey").alias("k")), f, "k", "v")


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def off_diagonal(t):
    """Ordered pairs of different positions within a key."""
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey")
def unordered_pairs(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") <= F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"))


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y, c.n_nationkey AS z FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_regionkey = c.n_regionkey AND b.n_nationkey < c.n_nationkey")
def ordered_triples(t):
    a, b, c = (t.nation.alias(x) for x in "abc")
    two = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return two.join(c, (F.col("b.n_regionkey") == F.col("c.n_regionkey")) & (F.col("b.n_nationkey") < F.col("c.n_nationkey"))).select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"), F.col("c.n_nationkey").alias("z"))


@query("SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_totalprice > 400000")
def preimage(t):
    """A relation pulled back along a map: a join on the mapped key."""
    return t.lineitem.join(t.orders.where("o_totalprice > 400000"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber")


@query("SELECT x.n AS a, y.n AS b, z.n AS c FROM (SELECT n_nationkey n FROM nation WHERE n_regionkey = 0) x, (SELECT n_nationkey n FROM nation WHERE n_regionkey = 1) y, (SELECT n_nationkey n FROM nation WHERE n_regionkey = 2) z")
def sections(t):
    """One member of each of three small sets."""
    a, b, c = (t.nation.where(F.col("n_regionkey") == i).select(F.col("n_nationkey").alias(x)) for i, x in enumerate("abc"))
    return a.crossJoin(b).crossJoin(c)


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN -1 ELSE n_nationkey * 10 END AS v FROM nation")
def overwrite_map(t):
    base = t.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 10).alias("v"))
    return rel.overwrite(base, t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.lit(-1).alias("v")), "k", "v")


@query("SELECT DISTINCT s1.s_suppkey AS a FROM supplier s1 JOIN supplier s2 ON s1.s_nationkey = s2.s_nationkey AND s1.s_suppkey <> s2.s_suppkey AND abs(s1.s_acctbal - s2.s_acctbal) < 300")
def not_separated(t):
    """Members that are related to another one; a separated set has none."""
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    near = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") != F.col("b.s_suppkey")) & (F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal")) < 300)
    return a.join(b, near, "left_semi").select(F.col("a.s_suppkey").alias("a"))


@query("SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s.s_nationkey AND abs(c_acctbal - s.s_acctbal) < 100)")
def not_covered(t):
    near = (F.col("c_nationkey") == F.col("s_nationkey")) & (F.abs(F.col("c_acctbal") - F.col("s_acctbal")) < 100)
    return t.supplier.join(t.customer, near, "left_anti").select("s_suppkey")


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value FROM events) SELECT a.user_id AS x, b.user_id AS y FROM e a JOIN e b ON a.i = b.i AND a.user_id < b.user_id AND a.i <= 3 AND abs(a.value - b.value) < 4 GROUP BY ALL HAVING count(*) = 3")
def dynamical_entourage(t):
    """Pairs that stay close for the first three steps of their orbits: one join by the cells of all three, as wide as the bound, next cells included."""
    e = t.events.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("i <= 3")
    values = [F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"v{i}") for i in (1, 2, 3)]
    orbits = e.groupBy("user_id").agg(*values).where("user_id IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL")
    a = b = orbits.select("*", *[F.floor(F.col(f"v{i}") / 4).alias(f"c{i}") for i in (1, 2, 3)])
    for i in (1, 2, 3):
        c = F.col(f"c{i}")
        b = b.withColumn(f"c{i}", F.explode(F.array(c - 1, c, c + 1)))
    a, b = a.alias("a"), b.alias("b")
    met = F.col("a.user_id") < F.col("b.user_id")
    for i in (1, 2, 3):
        met &= (F.col(f"a.c{i}") == F.col(f"b.c{i}")) & (F.abs(F.col(f"a.v{i}") - F.col(f"b.v{i}")) < 4)
    return a.join(b, met).select(F.col("a.user_id").alias("x"), F.col("b.user_id").alias("y"))


@query("SELECT bool_and(b.r_regionkey IS NOT NULL) AS preserved FROM nation a LEFT JOIN region b ON a.n_regionkey = b.r_regionkey")
def lifts(t):
    """Whether two maps carry one relation into another: each mapped pair has a partner."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").agg(F.coalesce(F.bool_and(F.col("r_regionkey").isNotNull()), F.lit(True)).alias("preserved"))


@query("WITH r AS (SELECT DISTINCT l_linenumber AS a, l_suppkey % 5 AS b FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.08), j AS (SELECT DISTINCT a FROM r WHERE a <= 2), left_dual AS (SELECT b FROM r WHERE a IN (SELECT a FROM j) GROUP BY b HAVING count(*) = (SELECT count(*) FROM j)) SELECT a FROM r WHERE b IN (SELECT b FROM left_dual) GROUP BY a HAVING count(*) = (SELECT count(*) FROM left_dual)")
def concept_closure(t):
    """A set divided twice: its closure under the Galois connection of a relation."""
    r = t.lineitem.where("l_quantity > 45 AND l_discount > 0.08").select(F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 5).alias("b")).distinct()
    dual = rel.divide(r, "a", "b", r.where("a <= 2").select("a"), r.select("b"))
    return rel.divide(r, "b", "a", dual, r.select("a"))


@query("WITH w AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT p_brand FROM part), k AS (SELECT n_name AS name, n_regionkey = 0 AS deprecated FROM nation) SELECT name, CASE WHEN deprecated IS NULL THEN 'missing' WHEN deprecated THEN 'deprecated' ELSE 'ok' END AS status FROM w LEFT JOIN k USING (name)")
def probe_names(t):
    """Names against those that are known, the nations': missing, deprecated or ok."""
    names = t.nation.select(F.col("n_name").alias("name")).unionAll(t.region.select("r_name")).unionAll(t.part.select("p_brand")).distinct()
    known = t.nation.select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("deprecated"))
    return names.join(known, "name", "left").select("name", F.when(F.col("deprecated").isNull(), "missing").when(F.col("deprecated"), "deprecated").otherwise("ok").alias("status"))


@query("WITH a AS (SELECT s_suppkey, x.n_nationkey AS x, y.n_nationkey AS y, 3 * abs(x.n_nationkey - s_nationkey) + abs(y.n_nationkey - s_suppkey % 25) + CASE WHEN x.n_nationkey = y.n_nationkey THEN 10 ELSE 0 END AS cost FROM supplier JOIN nation h ON h.n_nationkey = s_nationkey JOIN nation x ON x.n_regionkey = h.n_regionkey JOIN nation y ON y.n_regionkey = h.n_regionkey) SELECT s_suppkey, x, y, cost FROM a QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY cost, x, y) = 1")
def cheapest_assignment(t):
    """A valued constraint problem for each supplier: two nations of its region, near two keys and better not the same, at the least sum of costs."""
    n = t.nation.select("n_nationkey", "n_regionkey")
    at = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    ways = at.join(n.withColumnRenamed("n_nationkey", "x"), "n_regionkey").join(n.withColumnRenamed("n_nationkey", "y"), "n_regionkey")
    cost = 3 * F.abs(F.col("x") - F.col("s_nationkey")) + F.abs(F.col("y") - F.col("s_suppkey") % 25) + F.when(F.col("x") == F.col("y"), 10).otherwise(0)
    return ways.groupBy("s_suppkey").agg(F.min(F.struct(cost.alias("cost"), "x", "y")).alias("m")).select("s_suppkey", "m.x", "m.y", "m.cost")
