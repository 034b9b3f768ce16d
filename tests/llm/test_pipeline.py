"""The pipeline's stages against a brute-force version, each on its own input."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import mixing, quality
from tessera.llm.encoder import Encoder

from .test_operators import brute_components


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """name: (rows before, rows after)."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_stages_keep_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]
    for n in names[:-1]:
        assert stages[n][2] == stages[n][3]


def test_quality(stages):
    before, after, *_ = stages["quality_rules"]
    ok = {r["doc_id"] for r in before if (m := quality.measure(r["text"]))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert {r["doc_id"] for r in after} <= ok
    hosts = {r["source"] for r in after}
    assert {r["doc_id"] for r in before if r["doc_id"] in ok and r["source"] in hosts} == {r["doc_id"] for r in after}


def test_near_duplicates(stages):
    before, after, *_ = stages["jaccard_join"]
    heads = set(brute_components([(r["doc_id"], r["text"]) for r in before]).values())
    assert sorted(r["doc_id"] for r in after) == sorted(heads)


def test_benchmark(spark, folder, stages):
    before, after, *_ = stages["benchmark_decontamination"]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    items = [grams(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in before if not any(100 * len(q & grams(r["text"])) >= 80 * len(q) for q in items)}
    assert {r["doc_id"] for r in after} == clean


def test_mix(spark, stages):
    before, after, columns, _ = stages["source_mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(spark.createDataFrame(before)).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, n in plan.items() for _ in range(n))


def test_tokens(stages):
    before, after, *_ = stages["token_output"]
    e = Encoder()
    expected = sorted((r["doc_id"], zlib.crc32(np.append(e.encode([r["text"]])[0], 0).astype("<u4").tobytes())) for r in before)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in after) == expected
    at = 0
    for r in sorted(after, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


# odd rows, stage by stage: long enough to pass the rules where they should

LONG = " ".join(f"word{i}" for i in range(80))
NEAR = LONG.replace("word79", "other")
KEPT = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, LONG, "en", "b", 1),
    (3, LONG, None, "b", None),
    (3, LONG, "en", "b", 1),
    (4, NEAR, "en", None, 1),
    (5, "another text of its own " + " ".join(f"x{i}" for i in range(5000)), "en", "", 1),
]
EXTRA = ("k", "digest", "size", "key", "host", "component", "copies", "n_words", "kept", "start", "n_tokens", "id", "item_id", "rep", "seed", "mix_key", "component_mark")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture
def kept(spark):
    from pyspark.sql import functions as F

    from .conftest import DOCS

    return spark.createDataFrame(KEPT, DOCS).withColumns({x: F.lit("extra") for x in EXTRA})


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x))


def test_quality_stage_odd_rows(spark, folder, kept):
    out = stage("quality_rules")(spark, kept, folder)
    assert out.columns == kept.columns
    assert ids(out) == [None, 3, 3, 4, 5]


def test_jaccard_stage_odd_rows(spark, folder, kept):
    out = stage("jaccard_join")(spark, kept, folder)
    assert out.columns == kept.columns
    assert ids(out) == [None, 1, 2, 3, 5]


def test_benchmark_stage_odd_rows(spark, folder, kept, tmp_path):
    items = [(None, LONG), (1, LONG), (1, None), (2, ""), (3, "a few words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage("benchmark_decontamination")(spark, kept, str(tmp_path))
    assert out.columns == kept.columns
    assert ids(out) == [1, 2, 5]


def test_mixing_stage_odd_rows(spark, folder, kept):
    out = stage("source_mixing")(spark, kept, folder)
    assert out.columns == kept.columns
    found = ids(out)
    assert found == ids(stage("source_mixing")(spark, kept, folder))
    assert all(found.count(x) <= 3 * sum(r[0] == x for r in KEPT) for x in set(found))
    whole = {(r["text"], r["lang"]) for r in out.collect()}
    assert whole <= {(r[1], r[2]) for r in KEPT}


def test_token_stage_odd_rows(spark, folder, kept):
    rows = stage("token_output")(spark, kept, folder).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is not None, r[0] or 0) for r in KEPT)
    empty = zlib.crc32(np.array([0], "<u4").tobytes())
    assert all(r["n_tokens"] == 1 and r["ids_crc32"] == empty for r in rows if r["doc_id"] in (1, 2))


def test_stages_in_a_row_on_odd_and_empty_tables(spark, folder, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        for at, (_, f) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{at}")
            f(spark, docs, folder).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        # the one odd row of enough words repeats one word
        assert docs.count() == 0
