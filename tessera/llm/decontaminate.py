"""Operator 6: benchmark items inside documents, by size-partitioned MinHash containment search.

A document is far longer than an item, so their Jaccard similarity says nothing; what counts is the
share of the item's shingles that the document has. Items are partitioned by the size of their shingle
set, and the sketch of an item keeps as many of its smallest shingle hashes as its partition needs: with
m the partition's largest size and t the least containment, floor((1 - t) m) + 1 minima. A document
that holds the share t of the item lacks at most floor((1 - t) m) of its shingles, so it has one of
these minima, and the search misses nothing. The sketches' hashes are joined to the documents' shingle
hashes on the map side while their bytes are within a bound; beyond it a filter of one bit per place,
which is of a fixed size, drops on the map side nearly all shingles that no item has, and the rest is
joined by a shuffle. Candidates are verified on the shingles' strings themselves.

A shingle is five words in lower case; an item or text with fewer words is one shingle. Native DataFrame
functions only.

Cases. NULL or empty text or item: no shingles, never a match. An item shorter than a shingle matches a
text that has the item's words in a row. NULL ids: kept in the pairs. Repeated rows: equal pairs appear
once. Items of equal text: each is reported. An item is its text: a NULL item id is reported as NULL, and
an id with several texts has a row for each that is found. Empty tables: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, join_small, materialize

WORDS_PER_SHINGLE = 5
#: Least share of an item's shingles, in per cent.
LEAST = 80
#: Bytes of the minima, at ROW bytes each, that are sent to every executor.
BROADCAST_BYTES, ROW = 32 << 20, 96
#: Places of the filter that stands before the shuffle where the minima are more: a bit each, 16 MB in all.
PLACES, BUCKET = 1 << 27, 1 << 15


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def of_words(text: Column, f) -> Column:
    """f(words), the words computed once: they are a lambda's argument, which no rule copies into the lambdas inside f."""
    return F.transform(F.array(words(text)), f)[0]


def runs(w: Column, k: int, make) -> Column:
    """make(i) for each start i of k words in a row; none if there are fewer."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), make)).otherwise(F.array())


def hashed(k: int):
    """words -> the hashes of all runs of k words."""
    if k == WORDS_PER_SHINGLE:
        return lambda w: runs(w, k, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return lambda w: runs(w, k, lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, k), " ")))


def strung(k: int):
    """words -> the distinct runs of k words as strings."""
    return lambda w: F.array_distinct(runs(w, k, lambda i: F.array_join(F.slice(w, i + 1, k), " ")))


def item_shingles(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, k, n, shingles) of each item that has words; k is the words per shingle, fewer only for a shorter item, and item the digest of its text."""
    text = F.col(text_col).cast("string")
    w = benchmark.select(F.col(id_col).alias("item_id"), text.alias("text"), F.least(F.size(words(text)), F.lit(WORDS_PER_SHINGLE)).alias("k")).where("k > 0")
    cases = F.lit(None)
    for k in range(WORDS_PER_SHINGLE, 0, -1):
        cases = F.when(F.col("k") == k, of_words(F.col("text"), strung(k))).otherwise(cases)
    out = w.withColumn("shingles", cases)
    return out.select("item_id", F.md5("text").alias("item"), "k", F.size("shingles").alias("n"), "shingles")


def sketches(items: DataFrame, least: int = LEAST) -> DataFrame:
    """(k, h, item): the minima of each item; partitions are by the power of two below its size."""
    hashed = items.withColumn("part", F.floor(F.log2("n")))
    sizes = hashed.groupBy("part").agg(F.max("n").alias("m"))
    hashed = hashed.join(sizes, "part").withColumn("minima", F.floor((100 - least) * F.col("m") / 100).cast("int") + 1)
    mins = F.slice(F.array_sort(F.transform("shingles", lambda s: F.xxhash64(*[F.get(F.split(s, " "), j) for j in range(WORDS_PER_SHINGLE)]))), 1, F.col("minima"))
    short = F.slice(F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s))), 1, F.col("minima"))
    return hashed.select("k", "item", F.explode(F.when(F.col("k") == WORDS_PER_SHINGLE, mins).otherwise(short)).alias("h"))


def filtered(rows: DataFrame, minima: DataFrame) -> DataFrame:
    """The rows whose h may be one of the minima's: those whose place in a bit array of PLACES is set.

    The array is PLACES / BUCKET rows at most, whatever the minima's number, and is sent to every executor.
    """
    place = F.pmod("h", F.lit(PLACES))
    bits = minima.select(place.alias("place")).groupBy((F.col("place") / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % BUCKET).alias("bits"))
    bits = materialize(bits, "filter")
    at = rows.withColumn("place", place).withColumn("bucket", (F.col("place") / BUCKET).cast("int"))
    byte = F.conv(F.hex(F.substr("bits", ((F.col("place") % BUCKET) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return at.join(F.broadcast(bits), "bucket").where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select(*rows.columns)


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of each document that holds at least `least` per cent of an item's shingles."""
    listed = materialize(item_shingles(benchmark, item_col, item_text), "listed")
    items = materialize(listed.drop("item_id").dropDuplicates(["item"]), "items")
    names = materialize(listed.select("item", "item_id").distinct(), "names")
    sketch = materialize(sketches(items, least), "sketch")
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # five numbers at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small = sketch.count() * ROW <= BROADCAST_BYTES
    found = None
    for k in lengths:
        minima = sketch.where(F.col("k") == k).select("h", "item")
        hashes = of_words(F.col("text"), hashed(k))
        if small:
            rows = texts.select("doc_id", "text", F.explode(hashes).alias("h"))
            hits = rows.join(F.broadcast(minima), "h").select("doc_id", "text", "item").distinct()
        else:
            rows = texts.select(F.md5("text").alias("digest"), F.explode(F.array_distinct(hashes)).alias("h"))
            pairs = filtered(rows, minima).join(minima, "h").select("digest", "item").distinct()
            hits = pairs.join(texts.withColumn("digest", F.md5("text")), "digest").select("doc_id", "text", "item").distinct()
        found = hits if found is None else found.unionAll(hits)
    schema = "doc_id long, item_id long, n_item int, n_shared int"
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    # items hold their whole shingles, so their bytes are counted, not their rows
    width = items.agg(F.coalesce(F.sum(F.octet_length(F.array_join("shingles", "")) + 24 * F.size("shingles")), F.lit(0))).first()[0]
    held = found.join(F.broadcast(items) if width <= BROADCAST_BYTES else items, "item")
    cases = F.lit(None)
    for k in lengths:
        cases = F.when(F.col("k") == k, of_words(F.col("text"), strung(k))).otherwise(cases)
    held = held.withColumn("n_shared", F.size(F.array_intersect("shingles", cases)))
    held = held.where(100 * F.col("n_shared") >= least * F.col("n"))
    held = held.groupBy("doc_id", "item").agg(F.max("n").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return join_small(held, names, "item", "inner").select("doc_id", "item_id", "n_item", "n_shared")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns.

    Whether a row holds an item depends on its text alone, so rows are matched by their text's digest,
    which every row has, whatever its id.
    """
    key = free_name(docs.columns, "text_digest")
    texts = docs.select(F.md5(F.col(text_col).cast("string")).alias("digest"), F.col(text_col).alias("text"))
    leaks = materialize(search(texts, benchmark, "digest", "text", **options).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    rows = docs.withColumn(key, F.md5(F.col(text_col).cast("string")))
    return join_small(rows, leaks, key, "left_anti").drop(key)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    found = search(docs, items)
    return found.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, k, list_slice(w, x, x + k - 1) AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS x FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM s),
t AS (SELECT DISTINCT doc_id, k, list_slice(w, x, x + k - 1) AS s FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS x FROM d, k)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared, count(*) / any_value(n_item) AS containment
FROM t JOIN s USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
