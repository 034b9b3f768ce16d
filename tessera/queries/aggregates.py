"""Aggregates with their identities."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators.relations import running_total
from ..registry import query


@query("SELECT o_orderpriority, count(*) FILTER (o_totalprice > 200000) AS n FROM orders GROUP BY 1")
def count_if(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 200000).alias("n"))


@query("SELECT count(*) FILTER (l_returnflag IS NOT DISTINCT FROM 'R') AS n FROM lineitem")
def count_value(t):
    return t.lineitem.agg(F.count_if(F.col("l_returnflag").eqNullSafe("R")).alias("n"))


@query("SELECT coalesce(sum(l_linenumber), 0)::BIGINT AS total, coalesce(max(l_linenumber), -1) AS top FROM lineitem WHERE l_quantity > 1000")
def empty_sum_and_sup(t):
    """No rows: the sum is 0 and the supremum the bottom."""
    none = t.lineitem.where("l_quantity > 1000")
    return none.agg(F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("total"), F.coalesce(F.max("l_linenumber"), F.lit(-1)).alias("top"))


@query("SELECT n_regionkey, round(product(1 + n_nationkey / 100.0), 6) AS prod, min(n_nationkey) AS inf, max(n_nationkey) AS sup FROM nation GROUP BY 1")
def product_inf_sup(t):
    return t.nation.groupBy("n_regionkey").agg(F.round(F.coalesce(F.product(1 + F.col("n_nationkey") / 100.0), F.lit(1.0)), 6).alias("prod"), F.min("n_nationkey").alias("inf"), F.max("n_nationkey").alias("sup"))


@query("SELECT n_regionkey, bit_xor(n_nationkey) AS folded FROM nation GROUP BY 1")
def fold_xor(t):
    """A fold of a commutative and associative operation that is built in; others fold over sorted arrays of bounded groups."""
    return t.nation.groupBy("n_regionkey").agg(F.bit_xor("n_nationkey").alias("folded"))


@query("SELECT sum(DISTINCT p_size * p_size)::BIGINT AS folded FROM part")
def fold_image(t):
    return t.part.select((F.col("p_size") * F.col("p_size")).cast("long").alias("x")).distinct().agg(F.coalesce(F.sum("x"), F.lit(0)).alias("folded"))


@query("SELECT conv_id, sum(CASE WHEN turn % 2 = 0 THEN length(text) ELSE -length(text) END)::BIGINT AS alternating FROM conversations GROUP BY conv_id")
def alternating_sum(t):
    return t.conversations.groupBy("conv_id").agg(F.sum(F.when(F.col("turn") % 2 == 0, F.length("text")).otherwise(-F.length("text"))).alias("alternating"))


@query("SELECT n_regionkey, round(exp(sum(CASE WHEN pos % 2 = 0 THEN ln(n_nationkey + 1) ELSE -ln(n_nationkey + 1) END)), 9) AS alternating FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation) GROUP BY 1")
def alternating_product(t):
    pos = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    x = (F.col("n_nationkey") + 1).cast("double")
    return t.nation.withColumn("pos", pos).groupBy("n_regionkey").agg(F.round(F.product(F.when(F.col("pos") % 2 == 0, x).otherwise(1 / x)), 9).alias("alternating"))


@query("SELECT l_returnflag, count(*) FILTER (l_quantity > 30) / count(*) AS density FROM lineitem GROUP BY 1")
def density(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.coalesce(F.count_if(F.col("l_quantity") > 30) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("density"))


@query("SELECT n_nationkey, n_nationkey - avg(n_nationkey) OVER () AS x FROM nation")
def balance(t):
    """Less the mean: one number joined to each row, rather than a window over all of them."""
    mean = t.nation.agg(F.coalesce(F.avg("n_nationkey"), F.lit(0.0)).alias("m"))
    return t.nation.join(F.broadcast(mean), F.lit(True)).select("n_nationkey", (F.col("n_nationkey") - F.col("m")).alias("x"))


@query("SELECT n_nationkey, round(var_pop(n_nationkey) OVER (PARTITION BY n_regionkey), 9) AS v, avg(n_nationkey) OVER (PARTITION BY n_regionkey) AS m FROM nation")
def conditional_variance(t):
    w = Window.partitionBy("n_regionkey")
    return t.nation.select("n_nationkey", F.round(F.var_pop("n_nationkey").over(w), 9).alias("v"), F.avg("n_nationkey").over(w).alias("m"))


@query("WITH c AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1) SELECT x, sum(n) OVER (ORDER BY x) / (SELECT sum(n) FROM c) AS p FROM c")
def distribution_function(t):
    """P(X <= x) for each value: a running total over the distinct values, without a window over all of them."""
    c = t.lineitem.groupBy(F.col("l_quantity").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return running_total(c, "x", "n", "upto").join(F.broadcast(total), F.lit(True)).select("x", (F.col("upto") / F.col("total")).alias("p"))


@query("SELECT l_linenumber AS x, count(*) AS mass FROM (SELECT l_linenumber FROM lineitem UNION ALL SELECT l_linenumber FROM lineitem WHERE l_quantity > 25) GROUP BY 1")
def sum_of_measures(t):
    one = t.lineitem.groupBy(F.col("l_linenumber").alias("x")).agg(F.count(F.lit(1)).alias("mass"))
    two = t.lineitem.where("l_quantity > 25").groupBy(F.col("l_linenumber").alias("x")).agg(F.count(F.lit(1)).alias("mass"))
    return one.unionAll(two).groupBy("x").agg(F.sum("mass").alias("mass"))


@query("SELECT count(*) FILTER (l_linenumber = 1) AS mass FROM lineitem")
def dirac_mass(t):
    return t.lineitem.agg(F.count_if(F.col("l_linenumber") == 1).alias("mass"))


@query("SELECT c_mktsegment, round(pow(sum(CAST(pow(abs(c_acctbal), 3) AS DECIMAL(38,4)))::DOUBLE, 1.0/3), 4) AS l3, max(abs(c_acctbal)) AS essential_sup, CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS variation FROM customer GROUP BY 1")
def norms(t):
    x = F.abs("c_acctbal")
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.pow(F.sum(F.pow(x, F.lit(3)).cast("decimal(38,4)")).cast("double"), F.lit(1.0 / 3)), 4).alias("l3"), F.max(x).alias("essential_sup"), F.sum(x.cast("decimal(18,2)")).cast("double").alias("variation"))


@query("SELECT s_suppkey, avg(s_acctbal) OVER w AS average, sum(CAST(s_acctbal AS DECIMAL(18,2))) OVER w::DOUBLE AS total FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)")
def birkhoff_sums(t):
    """Sums and means along an orbit of three steps: here the next rows of the nation."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(0, 2)
    return t.supplier.select("s_suppkey", F.avg("s_acctbal").over(w).alias("average"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).over(w).cast("double").alias("total"))


@query("SELECT conv_id, count(*) FILTER (s <> p) AS changes FROM (SELECT conv_id, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, sign(length(text) - 100) AS s FROM conversations) WHERE s <> 0) GROUP BY conv_id")
def sign_variations(t):
    s = t.conversations.select("conv_id", "turn", F.signum(F.length("text") - 100).alias("s")).where("s <> 0")
    return s.withColumn("p", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))).groupBy("conv_id").agg(F.count_if(F.col("s") != F.col("p")).alias("changes"))


@query("SELECT sum(n * (n - 1) // 2)::BIGINT AS pairs FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)")
def sum_over_product(t):
    """A sum over a dependent product, from sizes below the join."""
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


@query("SELECT event_type AS metric, CAST(avg(v) AS DOUBLE) AS mean FROM (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v, run) AS lo, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, run DESC) AS hi FROM (SELECT event_type, user_id % 10 AS run, round(sum(CAST(value AS DECIMAL(18,6)))::DOUBLE, 6) AS v FROM events GROUP BY ALL)) WHERE lo > 2 AND hi > 2 GROUP BY 1")
def trimmed_mean_of_runs(t):
    """Sum per run, then the mean over runs without the two lowest and the two highest."""
    runs = t.events.groupBy("event_type", (F.col("user_id") % 10).alias("run")).agg(F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 6).alias("v"))
    w = Window.partitionBy("event_type")
    ranked = runs.withColumn("lo", F.row_number().over(w.orderBy("v", "run"))).withColumn("hi", F.row_number().over(w.orderBy(F.desc("v"), F.desc("run"))))
    return ranked.where("lo > 2 AND hi > 2").groupBy(F.col("event_type").alias("metric")).agg(F.avg("v").alias("mean"))


@query("SELECT x, CASE WHEN x = 0 THEN 1 ELSE x * ln(x) + 1 - x END AS k FROM (SELECT l_quantity / 10 AS x FROM lineitem WHERE l_linenumber = 1)")
def kl_terms(t):
    from ..functions.maths import kl_term

    return t.lineitem.where("l_linenumber = 1").select((F.col("l_quantity") / 10).alias("x")).select("x", kl_term(F.col("x")).alias("k"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_by_count(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("SELECT label, round(sum(x * x), 3) AS energy FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label")
def embedding_energy(t):
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return t.embeddings.groupBy("label").agg(F.round(F.sum(squares), 3).alias("energy"))


@query("SELECT conv_id, CAST(len(list_filter(list_zip(l[2:], l[:-2]), lambda z: z[1] <> z[2])) AS BIGINT) AS switches FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def destuttered_roles(t):
    """Changes of role: the length of the roles without equal neighbours, less one."""
    roles = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return roles.select("conv_id", (F.size(arrays.destutter(F.col("l.role"))) - 1).cast("long").alias("switches"))
