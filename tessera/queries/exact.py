"""Results by rank, sets as bitmaps, sums in a chosen precision and folds that say what failed."""

import json

from pyspark.sql import functions as F

from ..functions import floats as X
from ..operators import bitmaps as B
from ..operators import ranking as R
from ..plans import folds
from ..registry import query


@query(
    "WITH p AS (SELECT a.n_regionkey AS r, [a.n_nationkey, b.n_nationkey, c.n_nationkey, d.n_nationkey, e.n_nationkey] AS l FROM nation a JOIN nation b USING (n_regionkey) JOIN nation c USING (n_regionkey) JOIN nation d USING (n_regionkey) JOIN nation e USING (n_regionkey) "
    "WHERE len(list_distinct([a.n_nationkey, b.n_nationkey, c.n_nationkey, d.n_nationkey, e.n_nationkey])) = 5) SELECT r AS n_regionkey, row_number() OVER (PARTITION BY r ORDER BY l) - 1 AS rank, array_to_string(l, ',') AS made FROM p"
)
def permutations_by_rank(t):
    """All orders of each region's nations, each made from its rank."""
    lists = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("l"))
    made = R.enumerated(lists, R.n_permutations(F.col("l")), lambda rank: R.permutation(F.col("l"), rank))
    return made.select("n_regionkey", "rank", F.array_join(F.transform("made", lambda x: x.cast("string")), ",").alias("made"))


@query("WITH s AS (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) SELECT l_orderkey, a.p AS a, b.p AS b, c.p AS c FROM s a JOIN s b USING (l_orderkey) JOIN s c USING (l_orderkey) WHERE a.p < b.p AND b.p < c.p")
def subsets_by_rank(t):
    """The sets of three parts within each order, from ranks; the size is a parameter."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("l"))
    made = R.subsets(lists, "l", 3)
    return made.select("l_orderkey", *[F.get("made", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query("WITH f AS (SELECT DISTINCT l_orderkey, l_returnflag AS a FROM lineitem), s AS (SELECT DISTINCT l_orderkey, l_linestatus AS b FROM lineitem), p AS (SELECT DISTINCT l_orderkey, l_suppkey::VARCHAR AS c FROM lineitem) SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b, c) - 1 AS rank, a, b, c FROM f JOIN s USING (l_orderkey) JOIN p USING (l_orderkey)")
def choices_by_rank(t):
    """One flag, one status and one supplier of each order, in every way and in the product's order, from ranks."""
    of = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array(of("l_returnflag"), of("l_linestatus"), of("l_suppkey")).alias("l"))
    made = R.choices(lists, "l")
    return made.select("l_orderkey", "rank", *[F.get("made", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query(
    r"WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations)), "
    r"w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM conversations), "
    r"f AS (SELECT conv_id, w, turn, k, row_number() OVER (PARTITION BY conv_id, w ORDER BY turn) AS seen FROM w JOIN t USING (conv_id, turn)) "
    r"SELECT t.conv_id, t.turn, sum(count(w) FILTER (seen = 1)) OVER (PARTITION BY t.conv_id ORDER BY t.turn)::BIGINT AS n_union, count(w) FILTER (seen = f.k) AS n_common FROM t LEFT JOIN f ON t.conv_id = f.conv_id AND t.turn = f.turn GROUP BY t.conv_id, t.turn"
)
def running_word_sets(t):
    """Per turn of a conversation, how many words any turn so far has used and how many all have: sets of words as bitmaps."""
    words = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))).alias("w"))
    sets = B.packed(B.numbered(words, "w"), ["conv_id", "turn"])
    return B.running_sizes(sets, t.conversations.select("conv_id", "turn"), "conv_id", "turn")


def _add_cents(state: dict, row: dict) -> dict:
    k = json.loads(row["props"])["k"]
    if k % 10 == 0:
        raise ValueError("k is a multiple of ten")
    if row["event_type"] == "error":
        raise RuntimeError("an error event")
    cents = round(row["value"] * 100)
    return {"n": state["n"] + 1, "total": state["total"] + cents, "most": max(state["most"], cents)}


def _merge_cents(a: dict, b: dict) -> dict:
    return {"n": a["n"] + b["n"], "total": a["total"] + b["total"], "most": max(a["most"], b["most"])}


@query(
    "WITH r AS (SELECT CASE WHEN (props->>'k')::INT % 10 = 0 THEN 'ValueError: k is a multiple of ten' WHEN event_type = 'error' THEN 'RuntimeError: an error event' ELSE 'folded' END AS kind, round(value * 100)::BIGINT AS cents FROM events) "
    "SELECT kind, count(*) AS n, CASE WHEN kind = 'folded' THEN sum(cents)::BIGINT END AS total, CASE WHEN kind = 'folded' THEN max(cents) END AS most FROM r GROUP BY kind"
)
def fold_collecting_failures(t):
    """One pass over the events that sums what it can and keeps each failed row with its reason."""
    state, failures = folds.fold_collecting(t.events.select("event_id", "event_type", "value", "props"), "event_id", {"n": 0, "total": 0, "most": 0}, _add_cents, _merge_cents)
    folded = t.spark.createDataFrame([("folded", state["n"], state["total"], state["most"])], "kind string, n long, total long, most long")
    failed = failures.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return folded.unionByName(failed, allowMissingColumns=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_extendedprice::FLOAT + (l_quantity / 7)::FLOAT)::DOUBLE * 16384)::BIGINT AS x FROM lineitem")
def single_precision_sums(t):
    """Sums of two numbers of 24 binary digits, exact and rounded once, as whole numbers of 2^-14."""
    total = X.add(X.from_double(F.col("l_extendedprice"), X.SINGLE), X.from_double(F.col("l_quantity") / 7, X.SINGLE), X.SINGLE)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (X.to_double(total) * 16384).cast("long").alias("x"))


@query("SELECT l_orderkey, (list_reduce(list(l_extendedprice::FLOAT ORDER BY l_extendedprice), lambda a, x: a + x)::DOUBLE * 16384)::BIGINT AS x FROM lineitem GROUP BY l_orderkey")
def single_precision_folds(t):
    """Each order's prices added one after another in 24 binary digits, each sum rounded."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("l"))
    return lists.select("l_orderkey", (X.total(F.col("l"), X.SINGLE) * 16384).cast("long").alias("x"))
