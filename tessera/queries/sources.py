"""Sources, sinks and text pipelines."""

from pyspark.sql import functions as F

from ..plans.tables import shared_path
from ..registry import query
from ..sources import files


def _path(t, name):
    return shared_path(t.spark, name)


@query("SELECT event_type AS metric, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS value, arg_max(user_id::VARCHAR, event_id) AS unit FROM events GROUP BY 1")
def combine_metrics(t):
    """Metrics written as JSON lines, read with their schema, added up; the last unit wins."""
    path = _path(t, "metrics")
    rows = t.events.select(F.concat_ws("#", F.lpad(F.col("event_id").cast("string"), 12, "0"), F.col("user_id").cast("string")).alias("unit"), F.col("event_type").alias("metric"), F.round(F.col("value") * 100).alias("value"))
    files.write_metrics(rows, path)
    out = files.combined(files.read_metrics(t.spark, path), "unit")
    return out.select("metric", "value", F.substring_index("unit", "#", -1).alias("unit"))


@query("SELECT (SELECT count(*) FROM benchmark) AS lines")
def count_lines(t):
    path = _path(t, "lines")
    t.benchmark.select(F.translate("text", "\n\r", "  ").alias("value")).write.text(path)
    return files.line_counts(t.spark, path).agg(F.sum("lines").alias("lines"))


@query("SELECT sum(strlen(translate(text, chr(10) || chr(13), '  ')) + 1)::BIGINT AS bytes FROM benchmark")
def count_bytes(t):
    path = _path(t, "bytes")
    t.benchmark.select(F.translate("text", "\n\r", "  ").alias("value")).write.text(path)
    return files.byte_counts(t.spark, path + "/*.txt").agg(F.sum("bytes").alias("bytes"))


@query("SELECT event_id, k, CASE WHEN k < 50 THEN k END AS below FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def typed_json(t):
    """A checked number of a JSON text, and the same as a number below a bound, NULL where it is not."""
    k = files.checked(F.col("props"), "k bigint", lambda v: v["k"].isNotNull())["k"]
    return t.events.select("event_id", k.alias("k"), files.below(k, 50).alias("below"))


@query("SELECT n_name || ' :: key' AS name, n_nationkey::VARCHAR AS leaf FROM nation UNION ALL SELECT n_name || ' :: region', n_regionkey::VARCHAR FROM nation WHERE n_regionkey > 0")
def flatten_nested(t):
    """Maps within maps, to paths and leaves; leaves that are NULL or hold a slash are dropped."""
    leaves = F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("region"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")), F.lit("path"), F.concat("n_name", F.lit("/x")))
    rows = t.nation.select(F.create_map("n_name", leaves).alias("m"))
    return files.flattened(rows, "m", 2).select(files.joined_path(F.col("path")).alias("name"), "leaf")


@query("SELECT n_name AS decl, 'r' || n_regionkey || ':' || n_nationkey AS refs FROM nation")
def cross_references(t):
    tags = t.nation.select(F.col("n_name").alias("decl"), F.concat(F.lit("r"), "n_regionkey").alias("db"), F.col("n_nationkey").cast("string").alias("id"), F.lit("").alias("comment"))
    return files.cross_references(tags).select("decl", F.array_join(F.transform("refs", lambda r: F.concat(r["db"], F.lit(":"), r["id"])), ",").alias("refs"))


@query("SELECT l.n_name, coalesce(r.r_name, '') AS module, coalesce(r.r_regionkey, 0) AS line FROM nation l LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON l.n_regionkey = r.r_regionkey")
def located(t):
    r = t.region.where("r_regionkey < 3")
    return t.nation.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("r_name", F.lit("")).alias("module"), F.coalesce("r_regionkey", F.lit(0)).alias("line"))


@query("SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents)")
def dictionary_codes(t):
    return files.dictionary(t.documents, "source")


@query("WITH c AS (SELECT n_name AS name, n_nationkey::VARCHAR AS k FROM nation), w AS (SELECT greatest(max(len(name)), 4)::INT AS a, greatest(max(len(k)), 3)::INT AS b FROM c) SELECT 0 AS ord, '| ' || rpad('name', a, ' ') || ' | ' || lpad('key', b, ' ') || ' |' AS line FROM w UNION ALL SELECT 1, '| :' || repeat('-', a - 1) || ' | ' || repeat('-', b - 1) || ': |' FROM w UNION ALL SELECT 2, '| ' || rpad(name, a, ' ') || ' | ' || lpad(k, b, ' ') || ' |' FROM c, w")
def markdown_table(t):
    """The nations as an aligned table."""
    return files.table_text(t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), {"name": "left", "key": "right"})


@query("SELECT event_type || '.lean' AS file, user_id::VARCHAR AS line, event_id::VARCHAR AS col, 'v_' || event_id AS var FROM events WHERE event_type <> 'view'")
def parse_log(t):
    """Lines of a build's log made of the events, those of views in another form, and parsed again."""
    fits = F.format_string("warning: %s.lean:%d:%d: unused variable `v_%d`", "event_type", "user_id", "event_id", "event_id")
    lines = t.events.select(F.when(F.col("event_type") == "view", F.concat(F.lit("note: "), fits)).otherwise(fits).alias("value"))
    return files.parsed_log(lines, r"^warning: ([^:]+):(\d+):(\d+): unused variable `(\w+)`$", ["file", "line", "col", "var"])


@query("SELECT 'P' || p_partkey AS module, unnest(['A' || p_size || '.B', 'C' || p_partkey]) AS import FROM part")
def parse_imports(t):
    """The imports at the head of a module for each part, a comment and a definition behind them."""
    rows = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("module"), F.format_string("import A%d.B\npublic import C%d\n-- import D\ndef x := 1\n", "p_size", "p_partkey").alias("content"))
    return files.imports_of(rows)


@query("SELECT lang, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE n_chars > 12000 GROUP BY lang")
def long_names_by_module(t):
    """Filter by length, group, collect in order."""
    rows = t.documents.where("n_chars > 12000").groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("l"))
    return rows.select("lang", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT source, count(DISTINCT doc_id) AS n FROM documents WHERE contains(text, 'License') GROUP BY source")
def find_substring(t):
    return t.documents.where(F.col("text").contains("License")).groupBy("source").agg(F.countDistinct("doc_id").alias("n"))


@query("SELECT url, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages WHERE starts_with(url, 'https')")
def page_hosts(t):
    return t.pages.where(F.col("url").startswith("https")).select("url", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'token = \"[0-9a-f]+')) AS n FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]+')")
def count_matches(t):
    n = F.regexp_count("text", F.lit('token = "[0-9a-f]+'))
    return t.documents.select("doc_id", n.cast("long").alias("n")).where("n > 0")


@query("SELECT p_name AS name, p_partkey, p_brand AS head FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_name LIKE '%a%' ORDER BY p_name, p_partkey LIMIT 20")
def index_search(t):
    """A hash index probe: only the head's folder is read, then a residual filter, then at most twenty."""
    path = _path(t, "index")
    t.part.select(F.col("p_name").alias("name"), "p_partkey", F.col("p_brand").alias("head")).write.partitionBy("head").parquet(path)
    head = t.part.agg(F.min("p_brand")).first()[0]
    return files.find_by_head(t.spark.read.parquet(path), head, F.col("name").contains("a"))


@query("SELECT n_name FROM nation WHERE n_nationkey < 3")
def sink_skips_existing(t):
    """Writing twice keeps what was there first."""
    path = _path(t, "sink")
    files.write_missing(t.nation.where("n_nationkey < 3").select("n_name"), path)
    files.write_missing(t.nation.select("n_name"), path)
    return t.spark.read.parquet(path)


@query("SELECT doc_id, string_agg(edit, ';' ORDER BY turn DESC) AS edits FROM (SELECT conv_id AS doc_id, turn, turn || ':' || role AS edit FROM conversations) GROUP BY doc_id")
def edits_in_reverse(t):
    """Edits per file, the last place first."""
    rows = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", F.col("turn").cast("string"), "role").alias("e"))), asc=False).alias("l"))
    return rows.select("doc_id", F.array_join("l.e", ";").alias("edits"))
