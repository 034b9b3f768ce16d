"""Sources and sinks on any path that Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = "metric string, value double, unit string"


def read_metrics(spark: SparkSession, *paths: str) -> DataFrame:
    """Metric rows of JSON lines files; a row of another shape is an error."""
    return spark.read.schema(METRICS).option("mode", "FAILFAST").json(list(paths))


def combined(rows: DataFrame, order: str) -> DataFrame:
    """Sum per metric and the unit of the last row, by metric."""
    return rows.groupBy("metric").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), F.max_by("unit", order).alias("unit")).orderBy("metric")


def write_metrics(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def trimmed_means(rows: DataFrame, k: int) -> DataFrame:
    """(metric, value): the sums per run, and their mean without the k lowest and the k highest."""
    sums = rows.groupBy("metric", "run").agg(F.sum("value").alias("v"))
    w = Window.partitionBy("metric")
    ranked = sums.withColumn("lo", F.row_number().over(w.orderBy("v", "run"))).withColumn("hi", F.row_number().over(w.orderBy(F.desc("v"), F.desc("run"))))
    return ranked.where((F.col("lo") > k) & (F.col("hi") > k)).groupBy("metric").agg(F.avg("v").alias("value"))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines)."""
    return spark.read.text(path).select(F.input_file_name().alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


def byte_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes), from the files' metadata alone."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def flattened(rows: DataFrame, column: str, depth: int) -> DataFrame:
    """(path, leaf) of a nested map column of a known depth; NULL leaves and leaves with a slash are dropped."""
    out = rows.select(F.array().cast("array<string>").alias("path"), F.col(column).alias("leaf"))
    for _ in range(depth):
        out = out.select("path", F.explode("leaf").alias("k", "v")).select(F.array_append("path", F.col("k")).alias("path"), F.col("v").alias("leaf"))
    return out.where(F.col("leaf").isNotNull() & ~F.col("leaf").contains("/"))


def joined_path(path: Column) -> Column:
    return F.concat_ws(" :: ", path)


def table_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(ord, line): rows as an aligned markdown table; columns give each column's alignment: left, center or right.

    Widths are one aggregate over all rows, joined to each row.
    """
    from ..functions.strings import justify, left_pad, right_pad

    cells = {c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns}
    widths = df.agg(*[F.greatest(F.coalesce(F.max(F.length(x)), F.lit(0)), F.lit(len(c)), F.lit(3)).alias(c) for c, x in cells.items()]).first().asDict()
    put = {"left": lambda x, n: right_pad(x, n, " "), "right": lambda x, n: left_pad(x, n, " "), "center": lambda x, n: justify(x, "center", n)}
    line = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    head = line([put[how](F.lit(c), widths[c]) for c, how in columns.items()])
    rule = line([F.lit({"left": ":" + "-" * (widths[c] - 1), "right": "-" * (widths[c] - 1) + ":", "center": ":" + "-" * (widths[c] - 2) + ":"}[how]) for c, how in columns.items()])
    one = df.sparkSession.range(1)
    rows = df.select(F.lit(2).alias("ord"), line([put[how](cells[c], widths[c]) for c, how in columns.items()]).alias("line"))
    return one.select(F.lit(0).alias("ord"), head.alias("line")).unionAll(one.select(F.lit(1), rule)).unionAll(rows)


def cross_references(tags: DataFrame) -> DataFrame:
    """(decl, refs): references of each declaration sorted by database and id."""
    refs = F.array_sort(F.collect_list(F.struct("db", "id", "comment")))
    return tags.groupBy("decl").agg(refs.alias("refs")).orderBy("decl")


def parsed_log(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """The groups of a pattern as columns; lines that don't match are dropped."""
    return lines.where(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def imports_of(files: DataFrame) -> DataFrame:
    """(module, import) of whole source files (module, content)."""
    found = F.regexp_extract_all("content", F.lit(r"(?m)^(?:public )?import ([\w.]+)"), F.lit(1))
    return files.select("module", F.explode(found).alias("import"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value with a dense number by order; the numbers come from a range sort, not a window over all."""
    from ..operators.relations import ordinal

    return ordinal(df.select(column).distinct(), column, name="code")


def checked(json: Column, schema: str, ok) -> Column:
    """A JSON value decoded and checked; one that fails the check raises an error."""
    value = F.from_json(json, schema, {"mode": "FAILFAST"})
    return F.when(F.assert_true(ok(value), "the value fails its check").isNull(), value)


def below(n: Column, bound: int) -> Column:
    """A natural number below a bound; NULL otherwise."""
    return F.when((n >= 0) & (n < bound), n)


def write_missing(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write unless the path has something already."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def destination(url: str | None, base: str | None, default: str, name: str) -> str:
    """Where a table goes: a whole URL before a base before the default."""
    return url or f"{(base or default).rstrip('/')}/{name}"


def destination_of(url: Column, base: Column, default: Column, name: Column) -> Column:
    """The same for columns: a URL that is there goes before a base, and that before the default."""
    return F.coalesce(url, F.concat_ws("/", F.regexp_replace(F.coalesce(base, default), "/+$", ""), name))


def find_by_head(index: DataFrame, head, residual: Column, limit: int = 20) -> DataFrame:
    """Index search: the rows of a head key, filtered, the first `limit` by name and then by their other columns. Written partitioned by head, only that folder is read."""
    return index.where((F.col("head") == F.lit(head)) & residual).orderBy("name", *[c for c in index.columns if c != "name"]).limit(limit)


def write_jdbc(df: DataFrame, url: str, table: str, parts: int = 8, **options: str) -> None:
    """Append to a database's table, over at most `parts` connections."""
    df.coalesce(parts).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, **options: str) -> DataFrame:
    """A database's table, read by `parts` tasks over ranges of a whole-number key; rows without a key are read by the first.

    The key's bounds are asked of the database, which also takes over filters, columns and sums. Keys far from
    even fill some ranges more than others; no row is lost, as the outer ranges are open. An empty table gives no rows.
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    low, high = rows.load().agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.load()
    return rows.options(partitionColumn=key, lowerBound=low, upperBound=max(high, low + 1), numPartitions=parts).load()
