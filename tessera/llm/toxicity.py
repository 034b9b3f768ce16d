"""Operator 1: toxic passages as maximum-scoring segments.

Fit. Per class, texts that contain a feature (a word, the beginning of a word, or two words in a row) are
counted over a bounded sample of labelled rows, and the same features over all documents. The counts over
all documents are the Dirichlet prior of each feature's log-odds between the classes, so that rare
features shrink to what is usual in the corpus. A word scores by its longest feature with enough evidence,
or by the pair that it ends if that scores more; any other word costs a little, which makes the expected
score of clean text negative. Texts of the sample that are copies of one another, as far as their least
shingle tells, count once: a large group of copies says no more of its words than one text.

Score. One linear scan over a text's word scores finds all maximal scoring segments (Ruzzo and Tompa).
Under the extreme-value law for such scores a segment of score s in n words is expected
K n exp(-lambda s) times by chance; lambda solves E[exp(lambda score)] = 1 over the words of clean text.
A document's evidence adds up lambda s - ln(K n) over its significant segments, and a logistic curve
turns it into a score from 0 to 1. Lambda, K and the curve are fitted out of fold: the sample is dealt
into `FOLDS` folds, copies together, and each fold is scored by the features of the others. Both classes
weigh the same in the curve.

Cases. NULL or empty text: no words, the score of a text without evidence. NULL labels and NULL ids are
not learned from; a NULL id counts as held out. Several labels of one id: the largest counts. No labels of
either class: every text gets the same score. Repeated rows: each is scored. Empty table: empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Most labelled rows that are learned from, by the smallest hash of their id.
FIT_ROWS = 40_000
#: Lengths of the word beginnings that are features beside the word itself.
STEMS = (8, 7, 6, 5, 4, 3)
#: Fewest texts of the sample that a feature needs, its least deviation from equal rates, and the weight of the prior in texts.
LEAST_DOCS, LEAST_Z, PRIOR = 3, 4.5, 10.0
#: Most features of a model, by their deviation.
MODEL_FEATURES = 200_000
#: Folds of the sample: lambda, K and the curve are fitted on scores by the features of the other folds.
FOLDS = 5
#: What a word without a feature scores.
COST = -0.35
#: Most and least of a feature's score.
MOST, LEAST = 4.0, -2.0
#: A segment is significant if fewer than so many of its score are expected by chance.
EXPECTED = 0.5
WORDS = re.compile(r"[^\W_]+").findall


def features(word: str) -> list[str]:
    """The word, then its beginnings, the longest first."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def words_of(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


def pairs_of(words: list[str]) -> set[str]:
    """Two words in a row, as features."""
    return set(map(" ".join, zip(words, words[1:], strict=False)))


def copy_key(words: list[str]) -> int:
    """Equal for copies and for most near copies: the least hash of a text's five words in a row."""
    k = min(5, len(words))
    return min((zlib.crc32(" ".join(words[i : i + k]).encode()) for i in range(len(words) - k + 1)), default=0) if words else 0


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), left to right, in linear time.

    Segments kept so far have the sums before and after them. A new one joins the nearest kept one whose
    sum before it is lower, unless that one ended on a sum at least as high.
    """
    kept: list[tuple[int, int, float, float]] = []  # start, stop, sum before, sum after
    back: list[int] = []  # for each kept segment the nearest one with a lower sum before it, or -1
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        new = (i, i + 1, total, total + x)
        total += x
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = back[j]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                back.append(j)
                break
            new = (kept[j][0], new[1], kept[j][2], new[3])
            del kept[j:], back[j:]
    return [(a, b, after - before) for a, b, before, after in kept]


@dataclass
class Model:
    """What scoring needs; its size is bounded by MODEL_FEATURES."""

    scores: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, float] = field(default_factory=dict)
    seconds: frozenset[str] = frozenset()  # words that end a pair
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -1.0  # without labels every text is more likely clean

    def word(self, w: str) -> float:
        get = self.scores.get
        if (s := get(w)) is not None:
            return s
        for k in STEMS:
            if len(w) > k and (s := get("^" + w[:k])) is not None:
                return s
        return COST

    def word_scores(self, words: list[str], memo: dict[str, float]) -> list[float]:
        """The score of each word of a text."""
        scores = list(map(memo.get, words))
        if None in scores:
            for i, s in enumerate(scores):
                if s is None:
                    scores[i] = memo[words[i]] = self.word(words[i])
        if self.pairs and not self.seconds.isdisjoint(words):
            for i in range(1, len(words)):
                if words[i] in self.seconds and (s := self.pairs.get(f"{words[i - 1]} {words[i]}")) is not None and s > scores[i]:
                    scores[i] = s
        return scores

    def passages(self, words: list[str], memo: dict[str, float] | None = None) -> list[tuple[int, int, float]]:
        """Significant segments (start, stop, evidence) in words."""
        scores = self.word_scores(words, {} if memo is None else memo)
        if not scores or max(scores) <= 0:
            return []
        floor = self.log_k + math.log(len(scores))
        found = ((a, b, self.rate * s - floor) for a, b, s in segments(scores))
        return [x for x in found if x[2] > -math.log(EXPECTED)]

    def evidence(self, words: list[str], memo: dict[str, float] | None = None) -> float:
        return math.log1p(sum(x[2] for x in self.passages(words, memo)))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * evidence))))


def log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int, share: float) -> float:
    """A feature's log-odds between the classes under a Dirichlet prior of its share of all documents."""
    prior = PRIOR * max(share, 1e-9)
    a, b = toxic + prior, clean + prior
    return math.log(a / max(n_toxic + PRIOR - a, 1e-9)) - math.log(b / max(n_clean + PRIOR - b, 1e-9))


def deviation(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """How far a feature's counts are from equal rates in both classes: the root of the likelihood ratio statistic.

    Unlike the log-odds' own standard error it does not blow up where one class has none of a feature.
    """
    n, rate = toxic + clean, n_toxic / (n_toxic + n_clean)
    part = lambda seen, meant: seen * math.log(seen / meant) if seen else 0.0
    return math.sqrt(max(0.0, 2 * (part(toxic, n * rate) + part(clean, n * (1 - rate)))))


def logistic(rows: list[tuple[float, int]]) -> tuple[float, float]:
    """(slope, offset) of the likeliest logistic curve, by Newton steps; the classes weigh the same, and each end has half a case of either."""
    if not rows:
        return 0.0, 0.0
    often = Counter(y for _, y in rows)
    rows = [(x, float(y), len(rows) / (len(often) * often[y])) for x, y in rows]
    low, high = min(x for x, *_ in rows), max(x for x, *_ in rows)
    bins: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for x, y, w in [*rows, *[(e, y, 0.5) for e in (low, high) for y in (0.0, 1.0)]]:
        cell = bins[round(x, 2)]
        cell[0] += w
        cell[1] += w * y
    slope = offset = 0.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, (n, y) in bins.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, offset + slope * x))))
            g0, g1, v = g0 + y - n * p, g1 + (y - n * p) * x, n * p * (1 - p)
            h00, h01, h11 = h00 + v, h01 + v * x, h11 + v * x * x
        det = (h00 + 1e-6) * (h11 + 1e-6) - h01 * h01
        step0, step1 = ((h11 + 1e-6) * g0 - h01 * g1) / det, ((h00 + 1e-6) * g1 - h01 * g0) / det
        scale = min(1.0, 2.0 / max(abs(step0), abs(step1), 1e-12))
        offset, slope = offset + scale * step0, slope + scale * step1
        if max(abs(step0), abs(step1)) < 1e-7:
            break
    return slope, offset


def build(counts: list[tuple[str, int, int]], everywhere: dict[str, int], n_toxic: int, n_clean: int, n_all: int) -> dict[str, float]:
    """The scores of the features that tell the classes apart, by feature: at most MODEL_FEATURES, of the largest deviations."""
    found = []
    for f, toxic, clean in counts:
        if toxic + clean < LEAST_DOCS:
            continue
        delta, z = log_odds(toxic, clean, n_toxic, n_clean, everywhere.get(f, 0) / max(n_all, 1)), deviation(toxic, clean, n_toxic, n_clean)
        if z >= LEAST_Z:
            found.append((-z, f, max(LEAST, min(MOST, delta if delta > 0 else min(delta, COST)))))
    return {f: score for _, f, score in sorted(found)[:MODEL_FEATURES]}


def model_of(scores: dict[str, float]) -> Model:
    """A model of these features; a pair of words has a space."""
    pairs = {f: s for f, s in scores.items() if " " in f and s > 0}
    return Model(scores={f: s for f, s in scores.items() if " " not in f}, pairs=pairs, seconds=frozenset(f.rpartition(" ")[2] for f in pairs))


def chance(often: dict[float, int]) -> tuple[float, float]:
    """lambda and ln K of word scores that occur so often in clean text."""
    n = sum(often.values())
    if not n or max(often) <= 0 or sum(s * c for s, c in often.items()) >= 0:
        return 1.0, 0.0
    low, high = 1e-6, 50.0
    mean = lambda t: sum(c * math.exp(min(t * s, 700)) for s, c in often.items()) / n
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    # the share of words that can start a segment bounds K from above
    return low, math.log(max(sum(c for s, c in often.items() if s > 0) / n, 1e-9))


#: Entries that a worker's dictionaries have at most.
HELD = 300_000


LABELLED = "text string, toxic int, key long"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([copy_key(words_of(x.as_py())) for x in b.column(0)], pa.int64())], names=["text", "toxic", "key"])


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic, fold) of the labelled rows that are learned from: ids whose crc32 leaves a rest by 5, up to FIT_ROWS, by hash.

    Of texts with the same copy key and label one stays, the least by digest.
    """
    key = F.col("doc_id").cast("string")
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(key) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    # at most FIT_ROWS rows of two numbers are sent to the executors
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(texts.join(F.broadcast(sample), "doc_id").select("text", "toxic").mapInArrow(_keyed, LABELLED).withColumn("digest", F.md5("text")), "labelled-rows")
    one = rows.groupBy("key", "toxic").agg(F.min("digest").alias("digest")).distinct()
    texts = rows.join(one, ["key", "toxic", "digest"]).groupBy("key", "toxic", "digest").agg(F.first("text").alias("text"))
    return materialize(texts.select("text", "toxic", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")


COUNTED = "feature string, fold int, toxic long, clean long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, fold, toxic, clean): texts with a feature, by class; the feature '' stands for all texts. Pairs of toxic texts only."""
    both: dict[tuple[int, int], Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(f, fold, toxic, n) for (fold, toxic), c in both.items() for f, n in c.items()]
        both.clear()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        columns = [[r[0] for r in rows], [r[1] for r in rows], [r[3] * r[2] for r in rows], [r[3] * (1 - r[2]) for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["feature", "fold", "toxic", "clean"])

    for b in batches:
        for text, toxic, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = words_of(text.as_py())
            found = {f for w in set(words) for f in features(w)}
            if toxic:
                found |= pairs_of(words)
            both[fold, 1 if toxic else 0].update(found | {""})
            if sum(map(len, both.values())) > HELD:
                yield out()
    yield out()


def _paired(wanted: frozenset[str]):
    """Counts of the wanted pairs in clean texts, as _counted() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for text, toxic, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not toxic:
                    count.update((f, fold) for f in wanted & pairs_of(words_of(text.as_py())))
        rows = list(count.items())
        columns = [pa.array([f for (f, _), _ in rows], pa.string()), pa.array([k for (_, k), _ in rows], pa.int32()), pa.array([0] * len(rows), pa.int64()), pa.array([n for _, n in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "fold", "toxic", "clean"])

    return run


def _everywhere(wanted: frozenset[str]):
    seconds = frozenset(f.rpartition(" ")[2] for f in wanted if " " in f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        memo: dict[str, tuple[str, ...]] = {}
        for b in batches:
            for text in b.column(0):
                found = set()
                words = words_of(text.as_py())
                for w in set(words):
                    if (have := memo.get(w)) is None:
                        have = memo[w] = tuple(f for f in features(w) if f in wanted)
                    if have:
                        found.update(have)
                if not seconds.isdisjoint(words):
                    found.update(f for f in pairs_of(words) if f in wanted)
                count.update(found)
                count[""] += 1
            if len(memo) > HELD:
                memo.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["feature", "n"])

    return run


def _often(models: list[Model]):
    """How often each score occurs among the words of clean texts, each scored by the model of the other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        memos: list[dict[str, float]] = [{} for _ in models]
        for b in batches:
            for text, toxic, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not toxic:
                    count.update(models[fold].word_scores(words_of(text.as_py()), memos[fold]))
        cells: Counter = Counter()
        for s, n in count.items():
            cells[round(s, 2)] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.float64()), pa.array(list(cells.values()), pa.int64())], names=["score", "n"])

    return run


def _evidence(models: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict[str, float]] = [{} for _ in models]
        for b in batches:
            rows = [models[fold].evidence(words_of(text.as_py()), memos[fold]) for text, fold in zip(b.column(0), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.float64()), b.column(1)], names=["evidence", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled sample and the counts over all documents. What is collected is bounded by the sample and MODEL_FEATURES."""
    known = labelled_texts(docs, labels, id_col, text_col)
    counts = materialize(known.mapInArrow(_counted, COUNTED).groupBy("feature", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "features")
    totals = {r["fold"]: (r["toxic"], r["clean"]) for r in counts.where("feature = ''").collect()}  # one row per fold
    n1, n0 = sum(x for x, _ in totals.values()), sum(x for _, x in totals.values())
    if not n1 or not n0:
        return Model()
    whole = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a first look, which pairs pass by their toxic texts alone, leaves the features that may tell the classes apart
    n, rate = F.col("toxic") + F.col("clean"), n1 / (n1 + n0)
    part = lambda seen, meant: F.when(seen > 0, seen * F.ln(seen / meant)).otherwise(0.0)
    z = F.sqrt(F.greatest(2 * (part(F.col("toxic"), n * rate) + part(F.col("clean"), n * (1 - rate))), F.lit(0.0)))
    some = whole.where((F.col("feature") != "") & (F.col("toxic") + F.col("clean") >= LEAST_DOCS) & (z >= LEAST_Z - 0.5)).orderBy(z.desc(), "feature").limit(MODEL_FEATURES)
    wanted = materialize(some.select("feature"), "wanted")
    rows = [tuple(r) for r in counts.join(F.broadcast(wanted), "feature").collect()]
    single = frozenset(r[0] for r in rows if " " not in r[0])
    # a pair counts only where neither word tells the classes apart by itself
    pairs = frozenset(f for f in {r[0] for r in rows} - single if single.isdisjoint(x for w in f.split() for x in features(w)))
    rows, names = [r for r in rows if r[0] in single or r[0] in pairs], single | pairs
    if pairs:
        rows += [tuple(r) for r in known.mapInArrow(_paired(pairs), COUNTED).groupBy("feature", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()]
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    everywhere = {r["feature"]: r["n"] for r in texts.mapInArrow(_everywhere(names), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n_all = everywhere.pop("", 0)

    def scores(without: int | None) -> dict[str, float]:
        sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for f, fold, toxic, clean in rows:
            if fold != without:
                sums[f][0] += toxic
                sums[f][1] += clean
        lack = totals.get(without, (0, 0))
        return build([(f, *sums[f]) for f in sorted(sums)], everywhere, n1 - lack[0], n0 - lack[1], n_all)

    folds = [model_of(scores(k)) for k in range(FOLDS)]
    often = {r["score"]: r["n"] for r in known.mapInArrow(_often(folds), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()}
    model = model_of(scores(None))
    model.rate, model.log_k = chance(often)
    for x in folds:
        x.rate, x.log_k = model.rate, model.log_k
    model.slope, model.offset = logistic(sorted((r["evidence"], r["toxic"]) for r in known.mapInArrow(_evidence(folds), "evidence double, toxic int").collect()))
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("evidence", pa.float64())]))
        for b in batches:
            scores, spans = [], []
            for text in b.column(1):
                found = model.passages(words_of(text.as_py()), memo)
                scores.append(model.score(math.log1p(sum(x[2] for x in found))))
                spans.append([{"start": x, "stop": y, "evidence": e} for x, y, e in found])
                if len(memo) > HELD:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages) of each row; passages are (start, stop, evidence) in words."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_scored(model), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start: bigint, stop: bigint, evidence: double>>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))
