"""Graphs made of whole tables: each customer's orders in a row, nations that orders link, and small fixed graphs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..plans.tables import write_once
from ..registry import query

#: From each order to the next one of its customer in the same year; all orders.
_EDGES = "e AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"
_OPEN = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')"
#: The nations of a customer and of a supplier of one order, the smaller first; all orders.
_NATIONS = "e AS (SELECT DISTINCT least(c_nationkey, s_nationkey) AS src, greatest(c_nationkey, s_nationkey) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"


def _edges(t):
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("src"), after.alias("dst")).where("dst IS NOT NULL")


def _some(t):
    return t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))


def _nations(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.least("c_nationkey", "s_nationkey").alias("src"), F.greatest("c_nationkey", "s_nationkey").alias("dst")).where("src < dst").distinct()


@query(f"WITH {_EDGES} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def graph_symmetrized(t):
    return G.symmetrized(_edges(t))


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE src IN {_OPEN} AND dst IN {_OPEN}")
def graph_induced(t):
    return G.induced(_edges(t), _some(t)).select("src", "dst")


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE src NOT IN {_OPEN} AND dst NOT IN {_OPEN}")
def graph_without_vertices(t):
    return G.without_vertices(_edges(t), _some(t)).select("src", "dst")


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE (src IN {_OPEN}) <> (dst IN {_OPEN})")
def graph_edge_cut(t):
    return G.edge_cut(_edges(t), _some(t)).select("src", "dst")


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE src < dst")
def graph_restrict(t):
    e = _edges(t)
    return e.join(e.where("src < dst"), ["src", "dst"], "left_semi")


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE NOT src < dst")
def graph_delete_edges(t):
    e = _edges(t)
    return e.join(e.where("src < dst"), ["src", "dst"], "left_anti")


@query(f"WITH {_EDGES} SELECT DISTINCT src // 3 AS src, dst // 3 AS dst FROM e")
def graph_relabel(t):
    return _edges(t).select(F.expr("src div 3").alias("src"), F.expr("dst div 3").alias("dst")).distinct()


@query(f"WITH {_EDGES}, n AS (SELECT src AS eid, src AS v FROM e UNION ALL SELECT src, dst FROM e) SELECT DISTINCT a.eid AS a, b.eid AS b FROM n a JOIN n b ON a.v = b.v AND a.eid < b.eid")
def graph_line(t):
    return G.line_graph(_edges(t).withColumn("eid", F.col("src")))


@query(f"WITH {_EDGES} SELECT v, count(*) AS degree FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) GROUP BY v")
def graph_incidence(t):
    return _edges(t).select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {_EDGES} SELECT src AS v, src, dst FROM e UNION ALL SELECT dst, src, dst FROM e")
def graph_incidence_matrix(t):
    """Each edge's two ones in the matrix of vertices and edges."""
    return G.incidence(_edges(t))


@query(f"WITH {_NATIONS}, v AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT src AS v FROM (SELECT src, dst FROM e UNION SELECT dst, src FROM e) GROUP BY src HAVING count(*) = (SELECT count(*) - 1 FROM v)")
def graph_universal_vertices(t):
    both = G.symmetrized(_nations(t))
    n = both.select("src").distinct().agg(F.count(F.lit(1)).alias("n"))
    return both.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n") - 1).select("v")


@query(f"WITH {_EDGES} SELECT count(*) FILTER (src NOT IN {_OPEN} AND dst NOT IN {_OPEN}) = 0 AS covers FROM e")
def graph_vertex_cover(t):
    return G.without_vertices(_edges(t), _some(t)).agg((F.count(F.lit(1)) == 0).alias("covers"))


@query(f"WITH {_EDGES} SELECT a.src, c.dst, count(*) AS n FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src GROUP BY ALL")
def graph_walks(t):
    return G.walks(_edges(t), 3)


@query(f"WITH RECURSIVE {_EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def graph_closure(t):
    return G.closure(_edges(t))


@query(f"WITH RECURSIVE {_EDGES}, r(id) AS (SELECT dst FROM e WHERE src IN {_OPEN} UNION SELECT e.dst FROM r JOIN e ON r.id = e.src) SELECT DISTINCT id FROM r")
def graph_dependencies_below(t):
    return G.closure(_edges(t), _some(t)).select(F.col("dst").alias("id")).distinct()


@query(f"WITH RECURSIVE {_EDGES}, r(id, steps) AS (SELECT min(src), 0 FROM e UNION SELECT e.dst, r.steps + 1 FROM r JOIN e ON r.id = e.src) SELECT id, min(steps) AS steps FROM r GROUP BY id")
def graph_distances(t):
    edges = _edges(t)
    return G.distances(edges, edges.agg(F.min("src")).first()[0])


@query(f"WITH RECURSIVE {_EDGES}, r(id, steps, path) AS (SELECT min(src), 0, min(src)::VARCHAR FROM e UNION ALL SELECT e.dst, r.steps + 1, r.path || ',' || e.dst FROM r JOIN e ON r.id = e.src) SELECT id, steps, path FROM r")
def graph_shortest_paths(t):
    """A shortest path from the least vertex to each that it reaches, with its vertices."""
    edges = _edges(t)
    found = G.shortest_paths(edges, edges.agg(F.min("src")).first()[0])
    return found.select("id", "steps", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst, min(CAST(l_quantity AS DECIMAL(18,2))) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'P' GROUP BY ALL), r(id, w, k) AS (SELECT 0, 0::DECIMAL(18,2), 0 UNION ALL SELECT id, min(w), k FROM (SELECT e.dst AS id, (r.w + e.w)::DECIMAL(18,2) AS w, r.k + 1 AS k FROM r JOIN e ON r.id = e.src WHERE r.k < 6) GROUP BY ALL) SELECT id, min(w)::DOUBLE AS weight FROM r GROUP BY id")
def graph_weighted_distances(t):
    """The least sum of quantities over paths of nations from nation 0, an edge weighing its smallest quantity."""
    rows = t.lineitem.join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.min("l_quantity").alias("weight"))
    return G.weighted_distances(edges, 0).select("id", F.col("weight").cast("double").alias("weight"))


@query("WITH e AS (SELECT DISTINCT n_regionkey * 5 + n_nationkey % 5 AS src, n_nationkey AS dst FROM nation) SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.n_nationkey AND e.dst = b.n_nationkey)")
def graph_complement(t):
    """Pairs of nations without an edge."""
    n = t.nation
    edges = n.select((F.col("n_regionkey") * 5 + F.col("n_nationkey") % 5).alias("src"), F.col("n_nationkey").alias("dst")).distinct()
    return G.complement(edges, n.select(F.col("n_nationkey").alias("id")))


@query(f"WITH {_EDGES} SELECT a.src, c.dst, count(*) AS n FROM e a JOIN e c ON a.dst = c.src GROUP BY ALL")
def graph_walks_of_two(t):
    return G.walks(_edges(t), 2)


@query(f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, c) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.dst, r.c FROM r JOIN b ON r.id = b.src) SELECT id, min(c) AS component FROM r GROUP BY id")
def graph_weak_components(t):
    return G.weak_components(_edges(t))


@query(f"WITH RECURSIVE {_EDGES}, f AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE (src + dst) % 5 = 0), r(src, dst) AS (SELECT src, dst FROM f UNION SELECT r.src, f.dst FROM r JOIN f ON r.dst = f.src), v AS (SELECT src AS id FROM f UNION SELECT dst FROM f) SELECT v.id, least(v.id, coalesce(min(a.dst), v.id)) AS component FROM v LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) a ON a.src = v.id GROUP BY v.id")
def graph_strong_components(t):
    e = _edges(t)
    return G.strong_components(e.unionAll(e.where((F.col("src") + F.col("dst")) % 5 == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


#: From each order to the next one of its customer, and back from it to the order before it with the same leading part, that of its dearest line.
_BRANCHING = (
    "o AS (SELECT o_orderkey, o_custkey, o_orderdate, max_by(l_partkey, (l_extendedprice, l_partkey)) AS top FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), "
    "e AS (SELECT DISTINCT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM o UNION ALL SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY top ORDER BY o_orderdate, o_orderkey) FROM o) WHERE dst IS NOT NULL)"
)


def _branching(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.struct("l_extendedprice", "l_partkey"))["l_partkey"].alias("top"))
    o = write_once(t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(lines, "o_orderkey"))
    ahead = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    back = F.lag("o_orderkey").over(Window.partitionBy("top").orderBy("o_orderdate", "o_orderkey"))
    return write_once(o.select(F.col("o_orderkey").alias("src"), ahead.alias("dst")).unionAll(o.select("o_orderkey", back)).where("dst IS NOT NULL").distinct())


@query(
    f"WITH RECURSIVE {_BRANCHING}, p AS (SELECT a, z FROM (SELECT c_nationkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS a FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1) JOIN (SELECT c_nationkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS z FROM o JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey) USING (c_nationkey)), "
    "r(a, v, steps) USING KEY (a, v) AS (SELECT DISTINCT a, a, 0 FROM p UNION SELECT r.a, e.dst, min(r.steps + 1) FROM r JOIN e ON r.v = e.src LEFT JOIN recurring.r k ON k.a = r.a AND k.v = e.dst WHERE k.v IS NULL GROUP BY r.a, e.dst) "
    "SELECT p.a AS src, p.z AS dst, r.steps::INT AS steps, TRUE AS checked FROM p JOIN r ON r.a = p.a AND r.v = p.z"
)
def graph_witness_paths(t):
    """For each customer with an order, a shortest path from the first order of its nation to its own last one, checked edge by edge."""
    edges = _branching(t)
    with_lines = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    rows = with_lines.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    first = rows.groupBy("c_nationkey").agg(F.min_by("o_orderkey", "at").alias("src"))
    pairs = rows.groupBy("c_nationkey", "o_custkey").agg(F.max_by("o_orderkey", "at").alias("dst")).join(first, "c_nationkey")
    found = write_once(G.witness_paths(edges, pairs))
    steps = found.where("steps > 0").select("src", "dst", F.explode(F.expr("transform(sequence(0, steps - 1), i -> struct(path[i] AS u, path[i + 1] AS w))")).alias("s"))
    good = steps.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.lit(True).alias("edge")), (F.col("s.u") == F.col("u")) & (F.col("s.w") == F.col("w")), "left").groupBy("src", "dst").agg(F.count("edge").alias("good"))
    ends = (F.get("path", F.lit(0)) == F.col("src")) & (F.get("path", F.col("steps")) == F.col("dst"))
    return found.join(good, ["src", "dst"], "left").select("src", "dst", "steps", (ends & (F.coalesce("good", F.lit(0)) == F.col("steps"))).alias("checked"))


#: From each part to the parts on the lines after its dearest and its cheapest line in their suppliers' lists of lines.
_AFTER = (
    "l AS (SELECT l_partkey AS p, l_extendedprice AS x, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS q FROM lineitem), "
    "e AS (SELECT DISTINCT src, dst FROM (SELECT p AS src, unnest([max_by(q, (x, q)), min_by(q, (x, q))]) AS dst FROM l WHERE q IS NOT NULL GROUP BY p))"
)


@query(
    f"WITH RECURSIVE {_AFTER}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) "
    "SELECT v.id, least(v.id, coalesce(min(a.dst), v.id)) AS component FROM v LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) a ON a.src = v.id GROUP BY v.id"
)
def graph_strong_components_of_parts(t):
    """The parts that lead to each other by the lines after their dearest and cheapest lines: large cycles beside single parts."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    rows = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_extendedprice").alias("x"), after.alias("q")).where("q IS NOT NULL")
    key = F.struct("x", "q")
    edges = rows.groupBy("src").agg(F.max(key)["q"].alias("a"), F.min(key)["q"].alias("b")).select("src", F.explode(F.array("a", "b")).alias("dst"))
    return G.strong_components(edges)


@query(f"WITH RECURSIVE {_EDGES}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r(id, level) AS (SELECT id, 0 FROM v UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.id) SELECT id, max(level) AS level FROM r GROUP BY id")
def graph_topological_levels(t):
    return G.levels(_edges(t))


@query(f"WITH RECURSIVE {_EDGES}, n AS (SELECT o_orderkey AS id, o_orderpriority AS content FROM orders WHERE o_orderstatus <> 'P'), k AS (SELECT n.id, n.content, e.dst FROM n LEFT JOIN e ON e.src = n.id), r(id, digest) AS (SELECT id, md5(content || '|') FROM k WHERE dst IS NULL UNION ALL SELECT k.id, md5(k.content || '|' || r.digest) FROM r JOIN k ON k.dst = r.id) SELECT n.id, r.digest FROM n LEFT JOIN r ON n.id = r.id")
def graph_merkle_digests(t):
    """Digests of the orders over the orders that follow them; orders of status P are missing, and so is what needs them."""
    nodes = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))
    return G.merkle(nodes, _edges(t))


@query(f"WITH RECURSIVE {_NATIONS}, f AS (SELECT 'linked' AS g, src, dst FROM e UNION ALL SELECT DISTINCT 'two sides', c_nationkey, 100 + s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT 'tree', 100 + n_regionkey, n_nationkey FROM nation), u AS (SELECT g, src, dst FROM f UNION SELECT g, dst, src FROM f), w(g, root, prev, here, n) AS (SELECT g, src, src, dst, 1 FROM u WHERE src < dst UNION SELECT w.g, w.root, w.here, u.dst, w.n + 1 FROM w JOIN u ON w.g = u.g AND w.here = u.src WHERE u.dst <> w.prev AND w.here <> w.root AND w.n < 5) SELECT g AS graph, coalesce(min(n) FILTER (here = root), 0) AS girth FROM w GROUP BY g")
def graph_girth(t):
    """The shortest cycle among linked nations, between the nations of customers and of suppliers, and in the tree of regions."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    graphs = {
        "linked": _nations(t),
        "two sides": rows.select(F.col("c_nationkey").alias("src"), (F.col("s_nationkey") + 100).alias("dst")).distinct(),
        "tree": t.nation.select((F.col("n_regionkey") + 100).alias("src"), F.col("n_nationkey").alias("dst")),
    }
    return t.spark.createDataFrame([(name, G.girth(e)) for name, e in graphs.items()], "graph string, girth int")


@query("SELECT n_nationkey AS x FROM nation WHERE n_nationkey * n_nationkey % 25 = n_nationkey")
def fixed_points(t):
    return t.nation.where("n_nationkey * n_nationkey % 25 = n_nationkey").select(F.col("n_nationkey").alias("x"))


@query("WITH RECURSIVE p(s, i, x) AS (SELECT DISTINCT p_size, 0, p_size::BIGINT FROM part WHERE p_size > 0 UNION ALL SELECT s, i + 1, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END FROM p WHERE x <> 1) SELECT s AS p_size, max(i)::BIGINT AS steps FROM p GROUP BY s")
def iterate_to_fixpoint(t):
    """Iterating a map from each size of the parts until it comes to 1: a recursive query."""
    key = "spark.sql.cteRecursionLevelLimit"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, "500")
    try:
        statement = "WITH RECURSIVE p(s, i, x) AS (SELECT p_size, 0, CAST(p_size AS BIGINT) FROM {sizes} UNION ALL SELECT s, i + 1, CASE WHEN x % 2 = 0 THEN x div 2 ELSE 3 * x + 1 END FROM p WHERE x <> 1) SELECT s AS p_size, CAST(max(i) AS BIGINT) AS steps FROM p GROUP BY s"
        return write_once(t.spark.sql(statement, sizes=t.part.where("p_size > 0").select("p_size").distinct()))
    finally:
        t.spark.conf.set(key, before)


#: The parts as a binary tree: the path of each is its key in binary, the root's is 1.
_TREE = "t(path, v) AS (SELECT bin(p_partkey), p_size FROM part)"


def _tree(t):
    """A binary tree as a table keyed by bit paths."""
    return t.part.select(F.bin("p_partkey").alias("path"), F.col("p_size").alias("v"))


@query(f"WITH {_TREE} SELECT count(*) AS nodes, max(length(path)) AS height, max(CASE WHEN path = '101' THEN v END) AS found, min(CASE WHEN v = (SELECT max(v) FROM t) THEN path END) AS place, count(*) FILTER (path || '0' NOT IN (SELECT path FROM t) AND path || '1' NOT IN (SELECT path FROM t)) AS leaves FROM t")
def tree_measures(t):
    nodes = _tree(t)
    parents = nodes.where("length(path) > 1").select(F.expr("left(path, length(path) - 1)").alias("path")).distinct().withColumn("inner", F.lit(True))
    rows = nodes.join(parents, "path", "left")
    most = F.max(F.struct("v", "path"))["v"]
    out = rows.agg(F.count(F.lit(1)).alias("nodes"), F.max(F.length("path")).cast("long").alias("height"), F.max(F.when(F.col("path") == "101", F.col("v"))).alias("found"), most.alias("most"), F.count_if(F.col("inner").isNull()).alias("leaves"))
    place = nodes.groupBy("v").agg(F.min("path").alias("place"))
    return out.join(place, F.col("most") == F.col("v"), "left").select("nodes", "height", "found", "place", "leaves")


@query(f"WITH {_TREE} SELECT path, v * 2 AS v FROM t")
def tree_map(t):
    return _tree(t).select("path", (F.col("v") * 2).alias("v"))
