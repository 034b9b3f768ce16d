"""Operator 5: quality rules with host-level verdicts.

Every document is measured against five rules over its whole text: too few words, repeated words, symbols,
duplicate lines, and the mean length of its words. The first two are the base rules, which any document
must pass. Failures are added up per rule and host, and each rate is shrunk towards the rate that is usual
over all hosts by a beta prior of the rule's own, whose two parameters are fitted to the hosts' rates
(method of moments, with the rates' sampling noise taken off). A host whose shrunk rate is above the
prior's upper `TAIL` deviations is suspect by that rule. The verdicts are joined back: a document goes if
it fails a rule by which its host is suspect, and a host most of whose documents fail the base rules, by
its shrunk rate, goes as a whole.

Cases. NULL or empty text: no words, so the base rules fail. NULL host: no host, so no verdict; only
the base rules decide. Repeated rows: each counts. Equal rates at all hosts, or a single host: the prior
is as strong as `MOST_STRENGTH` documents, and no host is suspect. Empty table: empty result.
"""

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_name, join_small, materialize

#: Base rules: fewest words; most per cent of the words that lie in repeated windows of three.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules that count at suspect hosts: most symbols and most duplicate lines in per cent of the words and the lines; least and most mean length of a word.
MOST_SYMBOLS, MOST_DUPLICATES, WORD_LENGTHS = 10, 30, (3, 10)
#: A host is suspect by a rule if its shrunk rate is so many of the prior's deviations above the prior's mean.
TAIL = 1.645
#: A host goes as a whole where its shrunk rate of documents that fail the base rules is above this.
MOST_FAILING = 0.6
#: Bounds of the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS[1:-1].encode()))
SPACES = b" \t\n\v\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the rules need besides: the number of lines with a word.
ALL = (*MEASURES, "n_lines")
#: Rules, as SQL over the measures; the text of each is the same in Spark and in DuckDB.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeated": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * n_words",
    "duplicates": f"100 * n_dup_lines > {MOST_DUPLICATES} * n_lines",
    "lengths": f"word_chars < {WORD_LENGTHS[0]} * n_words OR word_chars > {WORD_LENGTHS[1]} * n_words",
}
#: The base rules together are one more thing that is counted per host.
FAILS = {"base": f"({RULES['few_words']}) OR ({RULES['repeated']})", **RULES}


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    in_words = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw.translate(None, NOT_SYMBOLS))
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip(SPACES)] if len(lines) > 1 else lines[: min(n, 1)]
    return n, in_words, symbols, len(full) - len(set(full)), repeated_words(words), len(full)


def repeated_words(words: list[bytes]) -> int:
    """Number of words in windows of three words that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    count, end = 0, 0  # words before `end` are counted
    for i, w in enumerate(windows):
        if often[w] > 1:
            count += i + 3 - max(end, i)
            end = i + 3
    return count


@F.arrow_udf(StructType([StructField(x, LongType()) for x in ALL]))
def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in texts]
    columns = zip(*rows, strict=True) if rows else [[]] * len(ALL)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(ALL))


def verdicts(rows: DataFrame) -> DataFrame:
    """(host, n, rate_r and suspect_r of each rule r) of each host that is not NULL, for rows (host, fails_r).

    With m and v the mean and variance of the hosts' rates, v less the mean of m (1 - m) / n for sampling
    noise, the prior is beta(m s, (1 - m) s) of strength s = m (1 - m) / v - 1; the shrunk rate is
    (failed + m s) / (n + s), and the prior's deviation sqrt(m (1 - m) / (s + 1)).
    """
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"fails_{r}").alias(f"failed_{r}") for r in FAILS])
    hosts = materialize(hosts, "host-failures")
    share = lambda r: F.col(f"failed_{r}") / F.col("n")
    prior = hosts.agg(F.avg(1 / F.col("n")).alias("noise"), *[F.avg(share(r)).alias(f"m_{r}") for r in FAILS], *[F.var_pop(share(r)).alias(f"v_{r}") for r in FAILS]).first()  # a dozen numbers
    out = [F.col("host"), F.col("n")]
    for r in FAILS:
        m = prior[f"m_{r}"] or 0.0
        v = (prior[f"v_{r}"] or 0.0) - m * (1 - m) * (prior["noise"] or 0.0)
        s = min(max(m * (1 - m) / v - 1, LEAST_STRENGTH), MOST_STRENGTH) if v > 0 else MOST_STRENGTH
        rate = (F.col(f"failed_{r}") + F.lit(m * s)) / (F.col("n") + F.lit(s))
        bound = m + TAIL * (m * (1 - m) / (s + 1)) ** 0.5
        out += [rate.alias(f"rate_{r}"), (F.lit(v > 0) & (rate > bound)).alias(f"suspect_{r}")]
    return hosts.select(*out)


def judged(rows: DataFrame, host_col: str, names: dict[str, str]) -> DataFrame:
    """rows, whose measures stand under names["measures"], with base_failed and kept under names["failed"] and names["kept"].

    The rows are written once. Each carries its own measures, so only the hosts' verdicts are joined, and
    no row is matched by its id.
    """
    host, fails = (free_name([*rows.columns, *names.values()], x) for x in ("quality_host", "quality_fails"))
    got = names["measures"]
    rows = materialize(rows.withColumn(host, F.col(f"`{host_col}`").cast("string")), "quality")
    tested = lambda rule: F.expr(re.sub("|".join(ALL), lambda x: f"`{got}`.{x[0]}", rule))
    rows = rows.withColumn(fails, F.struct(*[tested(rule).alias(r) for r, rule in FAILS.items()]))
    found = verdicts(rows.select(F.col(host).alias("host"), *[F.col(f"`{fails}`.{r}").alias(f"fails_{r}") for r in FAILS]))
    hosts = materialize(found.select(F.col("host").alias(host), F.struct((F.col("rate_base") > MOST_FAILING).alias("all"), *[F.col(f"suspect_{r}").alias(r) for r in RULES]).alias(names["kept"])), "hosts")
    joined = join_small(rows, hosts, host)
    base = F.col(f"`{fails}`.base")
    bad = F.col(f"`{names['kept']}`.all")
    for r in RULES:
        bad = bad | (F.col(f"`{names['kept']}`.{r}") & F.col(f"`{fails}`.{r}"))
    return joined.withColumn(names["failed"], base).withColumn(names["kept"], ~base & ~F.coalesce(bad, F.lit(False))).drop(host, fails)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, the five measures, base_failed, kept) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), _measured(F.col(text_col).cast("string")).alias("m"))
    found = judged(rows, "host", {"measures": "m", "failed": "base_failed", "kept": "kept"})
    return found.select("doc_id", *[F.col(f"m.{x}").alias(x) for x in MEASURES], "base_failed", "kept")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    names = {x: free_name(docs.columns, f"quality_{x}") for x in ("measures", "failed", "kept")}
    measured = docs.withColumn(names["measures"], _measured(F.col(f"`{text_col}`").cast("string")))
    return judged(measured, host_col, names).where(F.col(names["kept"])).select(*[F.col(f"`{x}`") for x in docs.columns])


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def _prior_sql(r: str) -> str:
    """The common tables of a rule's prior: its mean, strength and bound."""
    return rf"""
p_{r} AS (SELECT avg(failed_{r} / n) AS m, var_pop(failed_{r} / n) - avg(failed_{r} / n) * (1 - avg(failed_{r} / n)) * avg(1 / n) AS v FROM h),
s_{r} AS (SELECT m, v > 0 AS spread, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, {LEAST_STRENGTH}), {MOST_STRENGTH}) ELSE {MOST_STRENGTH} END AS s FROM p_{r}),
v_{r} AS (SELECT source, (failed_{r} + m * s) / (n + s) AS rate, spread AND (failed_{r} + m * s) / (n + s) > m + {TAIL} * sqrt(m * (1 - m) / (s + 1)) AS suspect FROM h, s_{r})"""


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM d),
t AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
y AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM x, range(3) r(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l2 AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS n_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, coalesce(l2.n_lines, 0)::BIGINT AS n_lines,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l2.n, 0)::BIGINT AS n_dup_lines, coalesce(y.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN y USING (doc_id) LEFT JOIN l2 USING (doc_id)),
f AS (SELECT *, FAILS FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, COUNTS FROM f WHERE source IS NOT NULL GROUP BY source),PRIORS
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails_base AS base_failed,
  NOT fails_base AND NOT coalesce(v_base.rate > 0.6 OR BAD, FALSE) AS kept
FROM f JOINS
"""
SQL = SQL.replace("FAILS", ", ".join(f"({rule}) AS fails_{r}" for r, rule in FAILS.items())).replace("COUNTS", ", ".join(f"count(*) FILTER (fails_{r}) AS failed_{r}" for r in FAILS))
SQL = SQL.replace("PRIORS", ",".join(map(_prior_sql, FAILS))).replace("BAD", " OR ".join(f"(v_{r}.suspect AND fails_{r})" for r in RULES)).replace("JOINS", " ".join(f"LEFT JOIN v_{r} ON f.source = v_{r}.source" for r in FAILS))
