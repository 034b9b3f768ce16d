"""Operator 2: mix sources to target weights.

Tokens are added up per source, each source's target gives its repetition rate, and every document
is emitted floor(rate) times plus one more copy with a probability equal to the rate's fraction.
That copy is a Bernoulli draw seeded by the document's hash and a seed of its source; of `SEEDS`
seeds a source uses the one whose draws come nearest to its target, so that reruns agree and a few
long documents don't carry a small source away from its share.

Cases. NULL or empty text: size 0, so nothing is taken from it. NULL source: a source of its own, the
last in order. Source without a word: target 0, rate 0. Repeated rows: each is mixed by itself, with
equal draws for equal ids. NULL id: drawn by the text's digest. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, join_small, materialize, n_words

#: Draws tried for each source.
SEEDS = 32
#: The range of a draw.
SPAN = 1 << 32


def targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size, target, rate, whole, cut): water-filling of the total over the sources.

    Filling by weight, a source is full at max_repeat times its size. Sources fill up in the order of
    max_repeat * size / weight, so those that are full are a prefix of that order, found by running sums.
    `sizes` has a row per source; its windows see sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    # the level of the first source that does not fill up holds for it and all after it
    final = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "source", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * final), F.col("cap")))
    s = s.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    return s.select("source", "source_size", "target", "rate", F.floor("rate").alias("whole"), ((F.col("rate") - F.floor("rate")) * SPAN).alias("cut"))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, names: dict[str, str]) -> DataFrame:
    """docs with the key of the source and the two halves of the id's hash, under the names given for key, h1 and h2.

    Rows without an id have their text's hash, so that they are drawn one by one and not as one block.
    """
    own = F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), own))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    return docs.withColumns({names["key"]: key, names["h1"]: part(1), names["h2"]: part(9)})


def draw(seed: Column, h1: str = "h1", h2: str = "h2") -> Column:
    """The document's draw under a seed: two halves of its hash, combined."""
    return F.pmod(F.col(h1) + F.col(h2) * seed, F.lit(SPAN))


def source_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_repeat: int) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, size, key, h1, h2) and the sources' (key, source_size, target, whole, cut, seed), both written."""
    narrow = keyed(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, {"key": "key", "h1": "h1", "h2": "h2"})
    rows = materialize(narrow.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), "key", "h1", "h2"), "mix-sizes")
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)))
    rates = materialize(targets(sizes, weights, max_repeat).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source"), "mix-rates")
    sums = join_small(rows, rates, "key", "inner").groupBy("key").agg(*[F.sum(F.when(draw(F.lit(k)) < F.col("cut"), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)])
    gap = F.array(*[F.struct(F.abs(F.col("target") - F.col("whole") * F.col("source_size") - F.col(f"s{k}")).alias("gap"), F.lit(k).alias("k")) for k in range(SEEDS)])
    return rows, materialize(sums.join(rates, "key").select("key", "source_size", "target", "whole", "cut", F.array_min(gap)["k"].cast("long").alias("seed")), "mix-seeds")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for each row of docs, under the weights in code-point order of the sources."""
    rows, rates = source_plan(docs, id_col, text_col, source_col, weights, max_repeat)
    copies = F.col("whole") + F.when(draw(F.col("seed")) < F.col("cut"), 1).otherwise(0)
    return join_small(rows, rates, "key", "inner").select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The mixed rows themselves, all columns of docs, each row as often as the mix takes it."""
    names = {x: free_name(docs.columns, f"mix_{x}") for x in ("key", "h1", "h2", "whole", "cut", "seed", "copy")}
    _, rates = source_plan(docs, id_col, text_col, source_col, weights, max_repeat)
    rates = rates.select(*[F.col(x).alias(names[x]) for x in ("key", "whole", "cut", "seed")])
    rows = join_small(keyed(docs, id_col, text_col, source_col, names), rates, names["key"], "inner")
    copies = F.col(names["whole"]) + F.when(draw(F.col(names["seed"]), names["h1"], names["h2"]) < F.col(names["cut"]), 1).otherwise(0)
    return rows.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[F.col(f"`{x}`") for x in docs.columns])


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL = rf"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL} AS size, md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS h FROM documents),
d2 AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2 FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
  source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0::DOUBLE)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (cap / weight, coalesce(source, chr(1114111)))) AS level FROM l WHERE cap > weight * level),
t AS (SELECT source, source_size, coalesce(least(cap, weight * f.level), cap) AS target FROM l LEFT JOIN f ON TRUE),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT *, floor(rate) AS whole, (rate - floor(rate)) * 4294967296 AS cut FROM r),
k AS (SELECT d2.doc_id, size, source_size, target, whole, cut, h1, h2, c.source FROM d2 JOIN c ON d2.source IS NOT DISTINCT FROM c.source),
g AS (SELECT k.source, x.seed, abs(any_value(target) - any_value(whole) * any_value(source_size) - sum(CASE WHEN (h1 + h2 * x.seed) % 4294967296 < cut THEN size ELSE 0 END)) AS gap
  FROM k, range({SEEDS}) x(seed) GROUP BY k.source, x.seed),
b AS (SELECT source, arg_min(seed, (gap, seed)) AS seed FROM g GROUP BY source),
o AS (SELECT doc_id, size, source_size, target, (whole + CASE WHEN (h1 + h2 * b.seed) % 4294967296 < cut THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies * size::BIGINT AS taken, copies FROM o
"""
