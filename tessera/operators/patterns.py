"""A pattern index: terms with holes in a trie that is a table, walked level by level for all terms at once.

A term is an array of tokens in preorder, struct(sym, arity): a symbol and how many terms follow as its
arguments. A list of words is a row of tokens of arity 0. A pattern may have holes (sym '*', with a number in
`hole`): each stands for one whole term, and holes of one number stand for equal terms.

The trie has a row per edge: (node, key, hole, child). Nodes are named by digests of what leads to them, so it is
built in one pass, without a round per level. A walk keeps (term, place, node, holes) rows and takes
one equi-join per level of the longest pattern, all in one pass; each row asks for its symbol's edge and for the holes' edges.
The score of a match is the number of symbols that had to be equal, and of holes met again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import write_once

#: Largest trie, in bytes of its edges, that is sent to every executor.
BROADCAST_BYTES = 16 << 20
ROOT = "root"
#: The key of a leaf's edge to itself; a symbol's key begins with a number.
STOP = "."
TOKENS = "array<struct<sym:string,arity:int>>"


def token(sym: Column | str, arity: int = 0) -> Column:
    """A symbol with its number of arguments."""
    return F.struct((F.col(sym) if isinstance(sym, str) else sym).cast("string").alias("sym"), F.lit(arity).alias("arity"))


def words(text: Column) -> Column:
    """The words of a text as a list of terms."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0), lambda w: F.struct(w.alias("sym"), F.lit(0).alias("arity")))


def ends(tokens: Column) -> Column:
    """For each token the place behind its whole term: a fold from the right with a stack of the ends so far, the nearest first."""
    n = F.size(tokens)

    def step(acc: Column, t: Column) -> Column:
        at = n - F.size(acc["out"])  # the place behind this token
        end = F.when(t["arity"] == 0, at).otherwise(F.get(acc["stack"], t["arity"] - 1))
        rest = F.slice(acc["stack"], t["arity"] + 1, F.greatest(F.size(acc["stack"]) - t["arity"], F.lit(0)))
        return F.struct(F.concat(F.array(end), rest).alias("stack"), F.concat(F.array(end), acc["out"]).alias("out"))

    none = F.array().cast("array<int>")
    folded = F.aggregate(F.reverse(tokens), F.struct(none.alias("stack"), none.alias("out")), step)["out"]
    # in a list of words each is a whole term
    return F.when(F.exists(tokens, lambda t: t["arity"] != 0), folded).otherwise(F.transform(tokens, lambda t, i: i + 1))


def _key(t: Column) -> Column:
    return F.concat_ws("/", t["arity"].cast("string"), t["sym"])


def index(patterns: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(edges, leaves, the longest pattern's tokens) of patterns (pattern_id, tokens: array<struct<sym,arity,hole>>); hole is NULL for a symbol.

    Leaves are (node, pattern_id). Patterns without tokens are left out.
    """
    step = F.expr("transform(tokens, t -> CASE WHEN t.hole IS NULL THEN concat('s', length(t.sym), ':', t.arity, '/', t.sym) ELSE concat('*', t.hole) END)")
    rows = patterns.where(F.size("tokens") > 0).select("pattern_id", "tokens", step.alias("steps"))
    name = lambda i: F.when(i == 0, F.lit(ROOT)).otherwise(F.md5(F.array_join(F.slice("steps", F.lit(1), i), "\x1f")))
    placed = rows.select("pattern_id", "steps", F.posexplode("tokens").alias("i", "t"))
    edges = placed.select(
        name(F.col("i")).alias("node"),
        F.when(F.col("t.hole").isNull(), _key(F.col("t"))).otherwise("*").alias("key"),
        F.col("t.hole").alias("hole"),
        name(F.col("i") + 1).alias("child"),
    ).distinct()
    leaves = rows.select(name(F.size("steps")).alias("node"), "pattern_id").distinct()
    longest = rows.agg(F.coalesce(F.max(F.size("tokens")), F.lit(0))).first()[0]
    return write_once(edges), write_once(leaves), longest


def _sized(edges: DataFrame) -> DataFrame:
    """Edges to broadcast where their bytes are few, else as they are."""
    size = edges.agg(F.coalesce(F.sum(F.length("node") + F.length("child") + F.length("key") + 16), F.lit(0))).first()[0]
    return F.broadcast(edges) if size <= BROADCAST_BYTES else edges


def matches(terms: DataFrame, patterns: DataFrame, whole: bool = True) -> DataFrame:
    """(term_id, pattern_id, score, holes) for each term (term_id, tokens) and pattern that it fits; holes: number to the term it stands for.

    whole: the pattern takes all of the term's tokens; otherwise a first part of them, as for windows of texts.
    A pattern that fits a term in one way is one row; there is only one way, as holes take whole terms. NULL
    and empty terms fit nothing.
    """
    edges, leaves, longest = index(patterns)
    # a leaf has an edge to itself, which a match takes until the longest pattern is through: all levels are one pass, and nothing is written between them
    stops = leaves.select("node", F.lit(STOP).alias("key"), F.lit(None).cast("int").alias("hole"), F.col("node").alias("child")).distinct()
    edges = _sized(edges.unionByName(stops))
    leaves = _sized(leaves.withColumn("child", F.lit("")).withColumn("key", F.lit(""))).select("node", "pattern_id")
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    # the first step asks before anything is made of a term's other tokens, so terms that no pattern begins cost one look
    walk = terms.where(F.size("tokens") > 0).withColumn("key", F.explode(F.array(_key(F.get("tokens", F.lit(0))), F.lit("*")))).where("key IS NOT NULL").withColumn("node", F.lit(ROOT))
    met = walk.join(edges, ["node", "key"]).select("term_id", "key", F.transform("tokens", _key).alias("keys"), ends(F.col("tokens")).alias("ends"), F.lit(0).alias("at"), "hole", "child", none.alias("holes"), F.lit(0).alias("score"))
    for i in range(longest + 1):
        if i:
            here, more = F.get("keys", F.col("at")), [] if whole else [F.lit(STOP)]
            asked = F.when((F.col("key") == STOP) | (F.col("at") >= F.size("keys")), F.array(F.lit(STOP))).otherwise(F.array(here, F.lit("*"), *more))
            met = walk.withColumn("key", F.explode(asked)).where("key IS NOT NULL").join(edges, ["node", "key"])
        stopped, holed = F.col("key") == STOP, F.col("hole").isNotNull()
        end = F.get("ends", F.col("at"))
        taken = F.when(holed, F.array_join(F.slice("keys", F.col("at") + 1, end - F.col("at")), " "))
        before = F.when(holed, F.try_element_at("holes", F.col("hole")))
        walk = met.where(~holed | before.isNull() | (before == taken)).select(
            "term_id",
            "key",
            "keys",
            "ends",
            F.when(stopped, F.col("at")).when(holed, end).otherwise(F.col("at") + 1).alias("at"),
            F.col("child").alias("node"),
            F.when(holed & before.isNull(), F.map_concat("holes", F.map_from_arrays(F.array("hole"), F.array(taken)))).otherwise(F.col("holes")).alias("holes"),
            (F.col("score") + F.when(~stopped & (~holed | before.isNotNull()), 1).otherwise(0)).alias("score"),
        )
    return walk.where(F.col("key") == STOP).join(leaves, "node").select("term_id", "pattern_id", "score", "holes")


def windows(texts: DataFrame, text: str, width: int) -> DataFrame:
    """(texts' other columns, at, tokens): the words from each place of a text on, as many as the widest pattern asks for."""
    w = F.col("__w")
    listed = texts.withColumn("__w", words(F.col(text))).drop(text)
    cut = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(i.alias("at"), F.slice(w, i + 1, F.lit(width)).alias("tokens")))
    return listed.where(F.size(w) > 0).select(*[c for c in listed.columns if c != "__w"], F.inline_outer(cut))
