"""Scalar functions on strings, numbers, arrays and maps."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import maths as M
from ..functions import strings as S
from ..operators import numbers
from ..operators.relations import ordinal
from ..registry import query

_NUMBERS = "n AS (SELECT p_partkey AS n FROM part)"


def _n(t):
    return t.part.select(F.col("p_partkey").cast("long").alias("n"))


@query("SELECT n_nationkey, repeat('*', greatest(12 - length(n_name), 0)) || n_name AS l, n_name || repeat('.', greatest(12 - length(n_name), 0)) AS r, repeat('x', 3) AS x, starts_with(n_name, 'A') AS a, ends_with(n_name, 'A') AS z, left(n_name, 1) AS head, repeat(' ', (greatest(15 - length(n_name), 0) // 2)::INT) || n_name || repeat(' ', (greatest(15 - length(n_name), 0) - greatest(15 - length(n_name), 0) // 2)::INT) AS c FROM nation")
def string_padding(t):
    n = F.col("n_name")
    return t.nation.select("n_nationkey", S.left_pad(n, 12, "*").alias("l"), S.right_pad(n, 12, ".").alias("r"), F.repeat(F.lit("x"), F.lit(3)).alias("x"), F.startswith(n, F.lit("A")).alias("a"), F.endswith(n, F.lit("A")).alias("z"), S.head(n).alias("head"), S.justify(n, "center", 15).alias("c"))


@query("SELECT p_partkey, array_to_string([upper(x) || '!' FOR x IN string_split(p_name, ' ')], ' ') AS mapped FROM part")
def map_tokens(t):
    return t.part.select("p_partkey", S.map_tokens(F.col("p_name"), " ", lambda x: F.concat(F.upper(x), F.lit("!"))).alias("mapped"))


@query("SELECT DISTINCT c FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' AND unicode(c) > 127")
def distinct_non_ascii(t):
    """Characters outside of ASCII: distinct within each text first, so that little is shuffled."""
    return t.documents.select(F.explode(S.non_ascii(F.col("text"))).alias("c")).distinct()


@query("SELECT doc_id, CASE WHEN length(h) = 16 THEN h END AS digits, ('0x' || substr(h, 13))::BIGINT AS low FROM (SELECT doc_id, substr(md5(doc_id::VARCHAR), 1, 16) AS h FROM documents)")
def hex_values(t):
    h = t.documents.select("doc_id", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16).alias("h"))
    value = S.hex_to_u64(F.col("h"))
    return h.select("doc_id", F.lower(F.lpad(F.conv(value.cast("string"), 10, 16), 16, "0")).alias("digits"), (value % 65536).cast("long").alias("low"))


@query("SELECT n_nationkey, right(lpad(printf('%x', n_nationkey * 1000), 16, '0'), 4) AS h FROM nation")
def hex_digits(t):
    return t.nation.select("n_nationkey", S.to_hex_digits(F.col("n_nationkey") * 1000, 2).alias("h"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY replace(text, chr(13) || chr(10), chr(10))")
def line_end_hash(t):
    """Texts that are equal but for their line ends: texts of odd ids get line ends of two characters first."""
    text = F.col("text")
    two = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))
    key = S.content_hash(F.when(F.col("doc_id") % 2 == 1, two).otherwise(text))
    return t.documents.groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("key")


@query("SELECT p_partkey, 'f(' || p_type || ', [b, c])|' || p_brand || '|[' || p_size || ', d]' AS parts FROM part")
def split_top_level(t):
    """A line made of each part's columns, cut at the commas outside of brackets."""
    line = F.concat(F.lit("f("), "p_type", F.lit(", [b, c]), "), "p_brand", F.lit(" , ["), F.col("p_size").cast("string"), F.lit(", d]"))
    return t.part.select("p_partkey", F.array_join(S.split_top_level(line), "|").alias("parts"))


@query()
def wrap_long_lines(t):
    return t.benchmark.select("item_id", S.wrapped(F.col("text"), 60).alias("text"))


@query("SELECT l_orderkey, l_linenumber, floor(x + 0.5)::BIGINT AS r, sign(x)::DOUBLE AS s FROM (SELECT l_orderkey, l_linenumber, (l_quantity::DOUBLE - 25) / 2 AS x FROM lineitem)")
def round_and_sign(t):
    x = (F.col("l_quantity").cast("double") - 25) / 2
    return t.lineitem.select("l_orderkey", "l_linenumber", M.round_up_ties(x).alias("r"), M.sign(x).alias("s"))


@query(f"WITH {_NUMBERS} SELECT n, abs(n - 100) AS d, CASE WHEN n >= 50 THEN n - 50 END AS minus, CASE WHEN n > 0 THEN n - 1 END AS pred, floor(sqrt(n))::BIGINT AS root, floor(pow(n, 1.0 / 3) + 1e-9)::BIGINT AS cube_root FROM n")
def natural_arithmetic(t):
    n = F.col("n")
    return _n(t).select("n", M.distance(n, M.long(100)).alias("d"), M.partial_minus(n, M.long(50)).alias("minus"), M.predecessor(n).alias("pred"), M.int_sqrt(n).alias("root"), M.nth_root(n, 3).alias("cube_root"))


@query("SELECT a.n AS a, b.n AS b, CASE WHEN a.n < b.n THEN b.n * b.n + a.n ELSE a.n * a.n + a.n + b.n END AS code, a.n AS x, b.n AS y FROM (SELECT n_nationkey::BIGINT AS n FROM nation) a, (SELECT r_regionkey::BIGINT AS n FROM region) b")
def pairing(t):
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("a")).crossJoin(t.region.select(F.col("r_regionkey").cast("long").alias("b")))
    rows = rows.withColumn("code", M.pair(F.col("a"), F.col("b")))
    x, y = M.unpair(F.col("code"))
    return rows.select("a", "b", "code", x.alias("x"), y.alias("y"))


@query(f"WITH {_NUMBERS} SELECT n, array_to_string([i FOR i IN range(0, 63) IF (n >> i) & 1 = 1], ',') AS bits FROM n")
def bit_indices(t):
    return _n(t).select("n", F.array_join(F.transform(M.bit_indices(F.col("n")), lambda i: i.cast("string")), ",").alias("bits"))


@query(f"WITH {_NUMBERS} SELECT n, list_max([k FOR k IN range(0, 40) IF n % pow(2, k)::BIGINT = 0]) AS two, list_max([k FOR k IN range(0, 26) IF n % pow(3, k)::BIGINT = 0]) AS three FROM n WHERE n > 0")
def valuations(t):
    return _n(t).where("n > 0").select("n", M.valuation(2, F.col("n")).cast("long").alias("two"), M.divided_out(3, F.col("n"))["k"].cast("long").alias("three"))


@query(f"WITH {_NUMBERS}, p AS (SELECT i FROM range(2, (SELECT max(p_partkey) + 1 FROM part)) r(i) WHERE len([j FOR j IN range(2, i) IF i % j = 0]) = 0) SELECT n, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') AS primes, coalesce(max(i), n) AS largest FROM n LEFT JOIN p ON n % i = 0 AND n > 0 GROUP BY n")
def primes_of(t):
    """The primes of each number by a sieve of blocks, so that work grows with the numbers and not with their roots."""
    found = numbers.factored(_n(t), "n")
    return found.select("n", F.array_join(F.transform("primes", lambda p: p.cast("string")), ",").alias("primes"), F.coalesce(F.try_element_at("primes", F.lit(-1)), "n").alias("largest"))


@query("SELECT n_nationkey, (SELECT min(x) FROM range(105) r(x) WHERE x % 3 = n_nationkey % 3 AND x % 5 = n_regionkey % 5 AND x % 7 = n_nationkey % 4) AS x FROM nation")
def chinese_remainder(t):
    key = F.col("n_nationkey")
    return t.nation.select("n_nationkey", M.crt(F.array(key % 3, F.col("n_regionkey") % 5, key % 4), F.array(F.lit(3), F.lit(5), F.lit(7))).alias("x"))


@query("SELECT p_partkey, n, (factorial((2 * n)::INT) // (factorial(n::INT) * factorial(n::INT)))::BIGINT AS central, (factorial((2 * n)::INT) // (factorial(n::INT) * factorial((n + 1)::INT)))::BIGINT AS catalan, CASE n WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE list_product([k FOR k IN range(1, n + 1) IF (n - k) % 2 = 0])::BIGINT END AS double_factorial FROM (SELECT p_partkey, (p_size % 11)::BIGINT AS n FROM part)")
def combinatorial_numbers(t):
    """Numbers of each part's size, taken by eleven."""
    n = (F.col("p_size") % 11).cast("long")
    return t.part.select("p_partkey", n.alias("n"), M.central_binomial(n).alias("central"), M.catalan(n).alias("catalan"), M.double_factorial(n).alias("double_factorial"))


@query("WITH RECURSIVE r(n, f, s, d) AS (SELECT 0::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1), s * f * (n + 1), d * (n + 1) + CASE WHEN n % 2 = 0 THEN -1 ELSE 1 END FROM r WHERE n < 6) SELECT p_partkey, n, s AS super, d AS derangements, ((pow(3, n) - 3 * pow(2, n) + 3) / 6)::BIGINT AS stirling3 FROM part JOIN r ON n = p_size % 7")
def recursive_numbers(t):
    """Numbers of each part's size, taken by seven."""
    n = (F.col("p_size") % 7).cast("long")
    return t.part.select("p_partkey", n.alias("n"), M.super_factorial(n).alias("super"), M.derangements(n).alias("derangements"), M.stirling_second(n, 3).alias("stirling3"))


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 60), g AS (SELECT n, a AS fib FROM f UNION ALL SELECT -n, CASE WHEN n % 2 = 0 THEN -a ELSE a END FROM f WHERE n > 0) SELECT p_partkey, n, fib FROM part JOIN g ON n = p_size - 25")
def fibonacci_numbers(t):
    """The number of each part's size less 25, on both sides of zero."""
    n = (F.col("p_size") - 25).cast("long")
    return t.part.select("p_partkey", n.alias("n"), M.fibonacci(n).alias("fib"))


@query("WITH RECURSIVE f(i, a, b) AS (SELECT 2, 1::BIGINT, 2::BIGINT UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 60), r(n, rest, s) AS (SELECT p_partkey::BIGINT, p_partkey::BIGINT, '' FROM part UNION ALL SELECT n, rest - a, s || CASE WHEN s = '' THEN '' ELSE ',' END || i FROM r JOIN f ON a <= rest AND rest < b) SELECT n, s AS indices FROM r WHERE rest = 0")
def zeckendorf_indices(t):
    return _n(t).select("n", F.array_join(F.transform(M.zeckendorf(F.col("n")), lambda i: i.cast("string")), ",").alias("indices"))


@query("SELECT x, round(acosh(x + 1), 9) AS ac, round(atanh(x / 60), 9) AS at, round(CASE WHEN x = 0 THEN 1 ELSE sin(x) / x END, 9) AS sinc, round(2 * exp(-2 * x), 12) AS e, round(CASE WHEN x >= 3 THEN 2 * 9 * pow(x, -3) ELSE 0 END, 12) AS p, round(1.5 / (pi() * ((x - 2) * (x - 2) + 2.25)), 12) AS c, round(pow(2, 3) / gamma(3) * pow(x, 2) * exp(-2 * x), 12) AS g, round(pow(0.7, x) * 0.3, 12) AS geo FROM (SELECT DISTINCT l_quantity AS x FROM lineitem)")
def special_functions(t):
    x = F.col("x")
    rows = t.lineitem.select(F.col("l_quantity").alias("x")).distinct()
    return rows.select("x", F.round(F.acosh(x + 1), 9).alias("ac"), F.round(F.atanh(x / 60), 9).alias("at"), F.round(M.sinc(x), 9).alias("sinc"), F.round(M.exponential_density(x, 2.0), 12).alias("e"), F.round(M.pareto_density(x, 3.0, 2.0), 12).alias("p"), F.round(M.cauchy_density(x, 2.0, 1.5), 12).alias("c"), F.round(M.gamma_density(x, 3.0, 2.0), 12).alias("g"), F.round(M.geometric_mass(x, 0.3), 12).alias("geo"))


@query("SELECT x, round(12 * x * pow(1 - x, 2), 9) AS b FROM (SELECT DISTINCT l_discount AS x FROM lineitem WHERE l_discount > 0)")
def beta_densities(t):
    rows = t.lineitem.select(F.col("l_discount").alias("x")).distinct().where("x > 0")
    return rows.select("x", F.round(M.beta_density(F.col("x"), 2.0, 3.0), 9).alias("b"))


@query("SELECT p_partkey, k, round((factorial(10) / (factorial(k::INT) * factorial((10 - k)::INT))) * pow(0.25, k) * pow(0.75, 10 - k), 9) AS p FROM (SELECT p_partkey, (p_size % 11)::BIGINT AS k FROM part)")
def binomial_masses(t):
    """The mass of each part's size, taken by eleven, of ten draws."""
    k = (F.col("p_size") % 11).cast("long")
    return t.part.select("p_partkey", k.alias("k"), F.round(M.binomial_mass(k, 10, 0.25), 9).alias("p"))


@query("SELECT l_orderkey, l_linenumber, l_tax = 0 AS bottom, round(CASE WHEN l_tax > 0 THEN ln(l_tax::DOUBLE) END, 9) AS x FROM lineitem")
def extended_logarithm(t):
    x = M.extended_log(F.col("l_tax").cast("double"))
    bottom = x == float("-inf")
    return t.lineitem.select("l_orderkey", "l_linenumber", bottom.alias("bottom"), F.round(F.when(~bottom, x), 9).alias("x"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS last_kept FROM (SELECT conv_id, role, max(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def dedup_keeps_last(t):
    """Roles of a conversation without duplicates, the last of each kept in order."""
    roles = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return roles.select("conv_id", F.array_join(A.distinct_keep_last(F.col("l.role")), ",").alias("last_kept"))


@query("SELECT n_regionkey, array_to_string(l[:2], ',') AS take, array_to_string(l[:greatest(len(l) - 2, 0)], ',') AS rdrop, array_to_string(l[-2:], ',') AS rtake, array_to_string(list_filter(l, lambda x, i: NOT (i > 1 AND FALSE)), ',') AS same, l = list_reverse(l) AS palindrome, len(l) * (len(l) + 1) // 2 AS pairs, len(l) * (len(l) - 1) AS off FROM (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)")
def array_slices(t):
    a = F.col("l")
    text = lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ",")
    rows = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("l"))
    return rows.select("n_regionkey", text(A.take(a, 2)).alias("take"), text(A.drop_right(a, 2)).alias("rdrop"), text(A.take_right(a, 2)).alias("rtake"), text(A.destutter(a)).alias("same"), A.is_palindrome(a).alias("palindrome"), F.size(A.unordered_pairs(a)).cast("long").alias("pairs"), F.size(A.off_diagonal(a)).cast("long").alias("off"))


@query(
    "WITH p AS (SELECT p_partkey, p_size::INT AS a, (p_partkey % 5)::INT AS b, (p_partkey % 3)::INT AS c FROM part), q AS (SELECT *, [a, b, c, a, b] AS l, [b, c, b, 2] AS m, list_filter([sign(a - 25)::INT, sign(b - 2)::INT, sign(c - 1)::INT], lambda x: x <> 0) AS s FROM p) "
    "SELECT p_partkey, '[' || array_to_string(range(0, c + 1), ',') || '],[' || array_to_string(range(c + 1, c + b + 2), ',') || ']' AS ranges, "
    "'[' || array_to_string(l[1:c + 1], ',') || '],[' || l[c + 2] || '],[' || array_to_string(l[c + 3:], ',') || ']' AS split, "
    "concat(a + 10, ',', b + 20) AS zipped, concat_ws(',', CASE WHEN c <> 0 THEN '0:' || c END, CASE WHEN b <> 0 THEN '1:' || b END, '2:-2') AS sparse, "
    "len(list_filter(range(1, len(s)), lambda i: s[i] <> s[i + 1])) AS changes, "
    "array_to_string(list_concat(list_concat(m[1:list_position(m, 2) - 1], [9]), m[list_position(m, 2) + 1:]), ',') AS replaced, concat(c, ',', a, ',', b) AS cycled, "
    "[1, 3, 6][len(list_distinct([a, b, c]))] AS perms, (a > 25) = (b > 2) AS agree, "
    "CASE WHEN c <> 0 THEN concat(a, ',', b, ',', c) WHEN b <> 0 THEN concat(a, ',', b) ELSE a::VARCHAR END AS kept, CASE WHEN c <> 0 THEN '0' WHEN b <> 0 THEN '0,0' ELSE '0,0,0' END AS suffix, "
    "a + b + c AS total, concat(a, ',', a + b, ',', a + b + c) AS states, greatest(b, c) < a AS less FROM q"
)
def array_functions(t):
    """Each array function on arrays made of every part's numbers."""
    a, b, c = F.col("p_size").cast("int"), (F.col("p_partkey") % 5).cast("int"), (F.col("p_partkey") % 3).cast("int")
    zero, two = F.lit(0), F.lit(2)
    text = lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ",")
    nested = lambda x: F.array_join(F.transform(x, lambda y: F.concat(F.lit("["), text(y), F.lit("]"))), ",")
    sparse = F.array_join(F.transform(A.sparse_entries(A.to_sparse(F.array(c, b, F.lit(-2)))), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    state = A.map_accumulate(F.array(a, b, c), zero, lambda s, x: (s + x, s + x), "int")
    return t.part.select(
        "p_partkey",
        nested(A.running_lengths(F.array(c + 1, b + 1))).alias("ranges"),
        nested(A.split_lengths(F.array(c + 1, F.lit(1), 3 - c), F.array(a, b, c, a, b))).alias("split"),
        text(A.zip_shorter(F.array(a, b, c), F.array(F.lit(10), F.lit(20)), lambda x, y: x + y)).alias("zipped"),
        sparse.alias("sparse"),
        A.sign_changes(F.array(a - 25, zero, b - 2, c - 1)).alias("changes"),
        text(A.replace_first(F.array(b, c, b, two), lambda x: x == 2, lambda x: F.lit(9))).alias("replaced"),
        text(A.cyclic_permute(F.array(a, b, c), [0, 1, 2])).alias("cycled"),
        F.size(F.array_distinct(A.permutations_of(F.array(a, b, c), 3))).alias("perms"),
        A.all_equivalent(F.array(a > 25, b > 2)).alias("agree"),
        text(A.drop_right_while(F.array(a, b, c, zero), lambda x: x == 0)).alias("kept"),
        text(A.take_right_while(F.array(a, b, c, zero), lambda x: x == 0)).alias("suffix"),
        A.folded(F.array(a, b, c), zero, lambda s, x: s + x).alias("total"),
        text(state["out"]).alias("states"),
        A.dershowitz_manna_less(F.array(b, b, c), F.array(a)).alias("less"),
    )


@query("SELECT o_custkey, CAST(sum(x) AS BIGINT) AS n FROM (SELECT o_custkey, 1 AS x FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def sparse_map_restricted(t):
    """A nested map per customer, restricted to one key, zeros dropped."""
    nested = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    rows = nested.select("o_custkey", F.explode(A.restricted(F.col("m"), F.array(F.lit("F")))).alias("k", "n"))
    return rows.where("n <> 0").select("o_custkey", "n")


@query("SELECT n_regionkey AS k, n_nationkey AS i, n_nationkey * 2 AS v FROM nation")
def curry_uncurry(t):
    """(k, i) to v, as a map of maps and back."""
    rows = t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("i"), (F.col("n_nationkey") * 2).alias("v"))
    curried = rows.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return curried.select("k", F.explode("m").alias("i", "v"))


_MATRIX = "m AS (SELECT l_suppkey % 5 AS i, l_linenumber AS j, count(*) AS v FROM lineitem GROUP BY ALL)"


def _matrix(t):
    return t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("i"), F.col("l_linenumber").alias("j")).agg(F.count(F.lit(1)).alias("v"))


@query(f"WITH {_MATRIX} SELECT j AS i, i AS j, v * 2 AS v FROM m")
def matrix_transpose(t):
    return _matrix(t).select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * 2).alias("v"))


@query(f"WITH {_MATRIX}, w AS (SELECT i, j, v % 3 AS v FROM m WHERE v % 3 <> 0) SELECT i, j, m.v * w.v AS v FROM m JOIN w USING (i, j)")
def matrix_hadamard(t):
    m = _matrix(t)
    w = m.select("i", "j", (F.col("v") % 3).alias("w")).where("w <> 0")
    return m.join(w, ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


@query("WITH m AS (SELECT c_nationkey AS i, s_nationkey AS j, count(*) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), s AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM m UNION ALL SELECT j, i, v FROM m) GROUP BY ALL) SELECT (SELECT count(*) = 0 FROM m WHERE (j, i, v) NOT IN (SELECT i, j, v FROM m)) AS plain, (SELECT count(*) = 0 FROM s WHERE (j, i, v) NOT IN (SELECT i, j, v FROM s)) AS both_ways")
def matrix_symmetric(t):
    """Whether the matrix of lines by the nations of customer and supplier is symmetric, and whether it is when added to its transpose."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    m = rows.groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.count(F.lit(1)).alias("v"))
    turned = lambda x: x.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    both = m.unionByName(turned(m)).groupBy("i", "j").agg(F.sum("v").alias("v"))
    holds = lambda x, name: x.join(turned(x), ["i", "j", "v"], "left_anti").agg((F.count(F.lit(1)) == 0).alias(name))
    return holds(m, "plain").join(F.broadcast(holds(both, "both_ways")), F.lit(True))


@query("WITH v AS (SELECT l_suppkey % 5 AS k, count(*) AS v FROM lineitem GROUP BY 1) SELECT (k + j) % 5 AS i, j, v FROM v, range(5) r(j)")
def matrix_circulant(t):
    """The circulant matrix of the numbers of lines by five classes of suppliers: the cell (i, j) has the number of class i - j."""
    v = t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return v.select("k", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("j")).select(((F.col("k") + F.col("j")) % 5).alias("i"), "j", "v")


@query("SELECT n_nationkey::BIGINT AS i, j::BIGINT AS j, (p = j)::INT AS v FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) - 1 AS p, count(*) OVER () AS n FROM nation), range(n) r(j)")
def matrix_of_bijection(t):
    """The matrix of the map from each nation's key to its place by name."""
    n = t.nation.agg(F.count(F.lit(1)).alias("n"))
    placed = ordinal(t.nation.select("n_nationkey", "n_name"), "n_name").join(F.broadcast(n), F.lit(True))
    cells = placed.select(F.col("n_nationkey").cast("long").alias("i"), "pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    return cells.select("i", "j", (F.col("pos") == F.col("j")).cast("int").alias("v"))


@query(f"WITH {_MATRIX} SELECT i // 2 AS bi, j // 2 AS bj, i % 2 AS i, j % 2 AS j, v FROM m")
def matrix_blocks(t):
    return _matrix(t).select(F.expr("i div 2").alias("bi"), F.expr("CAST(j div 2 AS INT)").alias("bj"), (F.col("i") % 2).alias("i"), (F.col("j") % 2).alias("j"), "v")
