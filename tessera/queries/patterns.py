"""The pattern index over the tables: order lines as terms with places in them, and word patterns in whole texts."""

from pyspark.sql import functions as F

from ..operators import patterns as P
from ..registry import query

_LINES = "t AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_linestatus AS s, cn.n_regionkey AS cr, c_nationkey AS cn, sn.n_regionkey AS sr, s_nationkey AS sn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey)"


def _hole(n):
    return F.struct(F.lit("*").alias("sym"), F.lit(0).alias("arity"), F.lit(n).alias("hole"))


def _sym(x, arity=0):
    return F.struct((F.lit(x) if isinstance(x, str) else x).cast("string").alias("sym"), F.lit(arity).alias("arity"), F.lit(None).cast("int").alias("hole"))


def _lines(t):
    """The different lines as line(flag, status, place(region, nation), place(region, nation)), the customer's place and the supplier's, with how many there are of each."""
    n = t.nation.select("n_nationkey", "n_regionkey")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("cr")), "c_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sr")), "s_nationkey")
    line = F.array(*[P.token(F.lit(x), k) if k else P.token(x) for x, k in (("line", 4), ("l_returnflag", 0), ("l_linestatus", 0), ("place", 2), ("cr", 0), ("c_nationkey", 0), ("place", 2), ("sr", 0), ("s_nationkey", 0))])
    kinds = rows.groupBy("l_returnflag", "l_linestatus", "cr", "c_nationkey", "sr", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select(F.struct("l_returnflag", "l_linestatus", "c_nationkey", "s_nationkey", "n").alias("term_id"), line.alias("tokens"))


@query(
    f"WITH {_LINES} SELECT p AS pattern, count(*) AS n, min(score)::BIGINT AS score FROM ("
    "SELECT 'same place' AS p, 2 AS score FROM t WHERE cn = sn UNION ALL "
    "SELECT 'same region', 4 FROM t WHERE cr = sr UNION ALL "
    "SELECT 'flag and status alike', 2 FROM t WHERE f = s UNION ALL "
    "SELECT 'anything', 1 FROM t UNION ALL "
    "SELECT 'from ' || cn, 5 - 1 FROM t UNION ALL "
    "SELECT 'R within ' || cr, 6 FROM t WHERE f = 'R' AND cr = sr) GROUP BY p"
)
def pattern_index_terms(t):
    """Lines of orders that fit patterns with holes: a hole takes a whole place, and one that stands twice asks for equal places. Equal lines are matched once."""
    line, place = _sym("line", 4), _sym("place", 2)
    fixed = [
        ("same place", [line, _hole(0), _hole(1), _hole(2), _hole(2)]),
        ("same region", [line, _hole(0), _hole(1), place, _hole(2), _hole(3), place, _hole(2), _hole(4)]),
        ("flag and status alike", [line, _hole(0), _hole(0), _hole(1), _hole(2)]),
        ("anything", [line, _hole(0), _hole(1), _hole(2), _hole(3)]),
    ]
    one = t.region.agg(F.count(F.lit(1)).alias("n"))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("pattern_id"), F.array(*v).alias("tokens")) for k, v in fixed])))
    nations = t.nation.select(F.concat(F.lit("from "), F.col("n_nationkey").cast("string")).alias("pattern_id"), F.array(line, _hole(0), _hole(1), place, _sym(F.col("n_regionkey")), _sym(F.col("n_nationkey")), _hole(2)).alias("tokens"))
    regions = t.region.select(F.concat(F.lit("R within "), F.col("r_regionkey").cast("string")).alias("pattern_id"), F.array(line, _sym("R"), _hole(0), place, _sym(F.col("r_regionkey")), _hole(1), place, _sym(F.col("r_regionkey")), _hole(2)).alias("tokens"))
    found = P.matches(_lines(t), rows.unionByName(nations).unionByName(regions))
    return found.groupBy(F.col("pattern_id").alias("pattern")).agg(F.sum("term_id.n").alias("n"), F.min("score").cast("long").alias("score"))


_WORD = r"[^\x20\x09-\x0D]+"


@query(
    f"WITH b AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS d FROM (SELECT w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT regexp_extract_all(text, '{_WORD}') AS w FROM benchmark))), "
    f"d AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS d FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents))) "
    "SELECT doc_id, count(*) AS n, count(*) FILTER (kind = 'hole') AS by_hole FROM ("
    "SELECT doc_id, 'hole' AS kind FROM d JOIN (SELECT DISTINCT a, c, d FROM b) b ON d.a = b.a AND d.c = b.c AND d.d = b.d UNION ALL "
    "SELECT doc_id, 'twice' FROM d JOIN (SELECT DISTINCT a, c FROM b) b ON d.a = b.a AND d.c = b.c AND d.b = d.d) GROUP BY doc_id"
)
def pattern_index_texts(t):
    """Word patterns of the benchmark in whole texts: `a * c d` with a hole for one word, and `a *0 c *0` with one word twice."""
    w = F.col("w")
    listed = t.benchmark.select(P.words(F.col("text"))["sym"].alias("w")).where(F.size("w") > 3)
    runs = listed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - 3), lambda i: F.slice(w, i, 4))).alias("r"))
    at = lambda i: _sym(F.get("r", F.lit(i)))
    patterns = runs.select(F.explode(F.array(F.array(at(0), _hole(0), at(2), at(3)), F.array(at(0), _hole(0), at(2), _hole(0)))).alias("tokens")).distinct()
    named = patterns.withColumn("pattern_id", F.struct(F.md5(F.to_json("tokens")).alias("digest"), F.isnotnull(F.get("tokens", F.lit(3))["hole"]).alias("twice")))
    terms = P.windows(t.documents.select("doc_id", "text"), "text", 4).select(F.struct("doc_id", "at").alias("term_id"), "tokens")
    found = P.matches(terms, named, whole=False)
    return found.groupBy(F.col("term_id.doc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("pattern_id.twice")).alias("by_hole"))
