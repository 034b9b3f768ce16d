"""Rules by priority, samplers, shrinking, permutations of lists, and where uploads go."""

from pyspark.sql import functions as F

from ..functions import more as X
from ..operators import ranking as R
from ..plans.folds import Rules
from ..registry import query
from ..sources import files

_U = "(('0x' || substr(md5('{0}|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("SELECT event_id, CASE WHEN value > 90 THEN 'high' WHEN event_type = 'error' THEN 'error' WHEN event_id % 2 = 0 THEN 'even' END AS rule, CASE WHEN value > 90 THEN 'v' || floor(value)::INT WHEN event_type = 'error' THEN 'e' || user_id WHEN event_id % 2 = 0 THEN 'x' END AS value FROM events")
def first_rule_that_applies(t):
    """Named rules added in any order and tried by priority: the first one with a result for a row."""
    rules = Rules()
    rules.add(1, "even", lambda: F.when(F.col("event_id") % 2 == 0, F.lit("x")))
    rules.add(9, "high", lambda: F.when(F.col("value") > 90, F.concat(F.lit("v"), F.floor("value").cast("int").cast("string"))))
    rules.add(5, "error", lambda: F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("user_id").cast("string"))))
    found = t.events.withColumn("found", rules.column())
    return found.select("event_id", F.col("found.rule").alias("rule"), F.col("found.value").alias("value"))


@query(f"SELECT event_id, floor({_U.format(3)} * (value + 1))::BIGINT AS below, floor(({_U.format(3)} + {_U.format(4)}) * 5)::BIGINT AS triangle, {_U.format(3)} < 0.5 AS coin FROM events")
def user_defined_samplers(t):
    """Draws for each event by a user's samplers, which make what they like of uniform numbers: below a bound, a triangle, a coin."""
    key = F.col("event_id")
    draw = lambda f, n: X.sampled(f, n, 3, key)
    return t.events.select("event_id", draw(lambda u: F.floor(u * (F.col("value") + 1)), 1).alias("below"), draw(lambda u, v: F.floor((u + v) * 5), 2).alias("triangle"), draw(lambda u: u < 0.5, 1).alias("coin"))


@query(
    "WITH f AS (SELECT p_partkey, p_size - 25 AS n, p_partkey % 20 + 1 AS d FROM part), a AS (SELECT p_partkey, i, unnest([abs(n) >> i, -(abs(n) >> i)]) AS num, unnest([0, 1]) AS s FROM f, range(1, 7) r(i) WHERE abs(n) >> (i - 1) > 0), "
    "b AS (SELECT p_partkey, j, d >> j AS den FROM f, range(1, 7) r(j) WHERE d >> j > 0) SELECT p_partkey, count(*) AS n, string_agg(num || '/' || den, ' ' ORDER BY i, s, j) AS tried FROM a JOIN b USING (p_partkey) GROUP BY p_partkey"
)
def shrunk_fractions(t):
    """What a search for a simpler failing case tries instead of each part's fraction."""
    tried = X.shrunk_fraction(F.col("p_size").cast("long") - 25, F.col("p_partkey") % 20 + 1)
    rows = t.part.select("p_partkey", tried.alias("l")).where(F.size("l") > 0)
    return rows.select("p_partkey", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: F.concat(x["num"].cast("string"), F.lit("/"), x["den"].cast("string"))), " ").alias("tried"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_extendedprice, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey")
def lists_permuted(t):
    """Each order's parts, listed by key, rearranged by the permutation that sorts their prices."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_extendedprice"))).alias("l"))
    made = X.permuted(F.col("l.l_partkey"), X.sorting(F.col("l.l_extendedprice")))
    return lists.select("l_orderkey", F.array_join(F.transform(made, lambda x: x.cast("string")), ",").alias("parts"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'store://host/' || split_part(split_part(url, '//', 2), '/', 1) || '/f' || page_id ELSE 'store://default/f' || page_id END AS place FROM pages")
def upload_destinations(t):
    """Where each page's file goes: to its whole URL, else below its host's base, else below the default."""
    k = F.col("page_id") % 3
    base = F.when(k == 1, F.concat(F.lit("store://host/"), F.regexp_extract("url", "//([^/]+)", 1), F.lit("/")))
    return t.pages.select("page_id", files.destination_of(F.when(k == 0, F.col("url")), base, F.lit("store://default"), F.concat(F.lit("f"), F.col("page_id").cast("string"))).alias("place"))


@query("WITH r AS (SELECT a.n_regionkey AS k, c.n_nationkey - b.n_nationkey >= b.n_nationkey - a.n_nationkey AS fits FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_regionkey = c.n_regionkey AND b.n_nationkey < c.n_nationkey) SELECT k AS n_regionkey, bool_and(fits) AS triplewise, count(*) FILTER (NOT fits) AS against FROM r GROUP BY k")
def triplewise(t):
    """Whether all rising triples of a region's nations widen, and how many don't: triples by rank."""
    lists = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("l"))
    made = R.subsets(lists, "l", 3)
    x, y, z = (F.get("made", F.lit(i)) for i in range(3))
    fits = (z - y) >= (y - x)
    return made.groupBy("n_regionkey").agg(F.bool_and(fits).alias("triplewise"), F.count_if(~fits).alias("against"))
