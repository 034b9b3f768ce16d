"""Operators 11 to 13 against brute-force versions, and their defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, periodic, queries, sharding

from .conftest import DOCS

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(folder):
    import pyarrow.parquet as pq

    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


# 13


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute_runs(words, times=3, least=24):
    """Every stretch by its definition: extended as far as its period holds, then its smallest period looked up."""
    out, n = set(), len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and smallest_period(words[i : j + q]) == q:
                out.add((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), kept)


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_query_equals_brute_force(spark, folder):
    mine = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_periodic_runs"](spark, folder).collect()}
    theirs = {}
    for doc_id, text in texts_of(folder):
        theirs[doc_id] = digests(planted(doc_id, WORDS.findall(text or "")))
    assert mine == theirs
    assert sum(x[0] > 0 for x in mine.values()) > 10


def made_texts():
    rng = random.Random(5)
    out = []
    for i in range(120):
        words = []
        while len(words) < rng.randint(10, 400):
            unit = [rng.choice("ab") if i % 2 else f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 30))]
            words += unit * rng.choice([1, 1, 3, 4, 9]) + unit[: rng.randrange(len(unit))]
        out.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return out


@pytest.mark.parametrize("lags", [1, 7, 4096])
def test_periodic_runs_in_ranges_equal_whole(spark, lags):
    rows = made_texts()
    found = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lags=lags).collect()
    assert len(found) == len(rows)
    for r in found:
        words = rows[r["doc_id"]][1].split()
        runs = brute_runs(words)
        assert [tuple(x) for x in r["runs"]] == runs
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r["collapsed"].split() == [w for i, w in enumerate(words) if i not in gone]
        assert r["n_words"] == len(words)


@pytest.mark.parametrize(("times", "least"), [(2, 4), (2, 30), (5, 5)])
def test_periodic_runs_of_other_exponents(spark, times, least):
    rows = made_texts()[:40]
    found = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), times=times, least=least).collect()
    for r in found:
        assert [tuple(x) for x in r["runs"]] == brute_runs(rows[r["doc_id"]][1].split(), times, least)


def test_periodic_odd_rows(spark, odd, none):
    assert periodic.periodic_runs(none).count() == 0
    for lags in (1, 4096):
        rows = periodic.periodic_runs(odd.withColumns({"words": F.lit(1), "runs": F.lit(2)}), lags=lags).collect()
        assert len(rows) == odd.count()
        by = {r["doc_id"]: r for r in rows}
        assert by[1]["collapsed"] == by[2]["collapsed"] == by[3]["collapsed"] == "" and by[1]["runs"] == []
        assert [tuple(x) for x in by[5]["runs"]] == [(0, 3000, 1)] and by[5]["collapsed"] == "word"
    made = periodic.with_planted_runs(odd.withColumn("words", F.lit(1)))
    assert made.columns == [*odd.columns, "words"] and made.count() == odd.count()


# 12


def brute_spread(rows, shards):
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    return max(total[s] for s in range(shards)) - min(total[s] for s in range(shards))


def test_sharding_query(spark, folder):
    rows = queries.QUERIES["op12_sharding"](spark, folder).collect()
    texts = dict(texts_of(folder))
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(places) <= set(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    again = queries.QUERIES["op12_sharding"](spark, folder).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)


def test_shards_are_near_equal(spark):
    rng = random.Random(1)
    docs = [(i, "x" * rng.randint(0, 500)) for i in range(5000)]
    rows, _ = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = rows.collect()
    assert len(rows) == 5000 and brute_spread(rows, 24) < 0.01 * sum(r["size"] for r in rows) / 24


def test_one_key_of_a_third_of_all_rows_is_spread(spark):
    docs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("some text of a document").alias("text"))
    rows = sharding.shard(docs, 12)[0].collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 9000 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_map_versions(spark):
    rng = random.Random(2)
    held = [sharding.Load(i, 0, rng.randint(1, 1000), 2) for i in range(2000)]
    at = sharding.first_map(held, 10)
    first = sharding.SlotMap(spark, sharding.new_path(spark, "map")).edit(held, at)
    even = sharding.rebalanced(held, at, 10)
    second = first.edit(held, even)
    assert first.shards() == at and second.shards() == even and second.version == 2
    total = lambda m, n: [sum(x.size for x in held if m[x.slot, x.piece] == s) for s in range(n)]
    assert max(total(even, 10)) - min(total(even, 10)) <= 20
    # few pieces move, and an even map stays as it is
    assert sum(at[k] != even[k] for k in at) < 400 and sharding.rebalanced(held, even, 10) == even
    more = sharding.grown(held, even, 10)
    assert all(more[k] in (even[k], 10) for k in even)
    assert abs(total(more, 11)[10] - sum(total(even, 10)) / 11) < 1000
    # fewer shards: pieces of the last one go elsewhere, and new slots are taken in
    fewer = sharding.rebalanced([*held, sharding.Load(5000, 0, 10, 1)], more, 10)
    assert set(fewer.values()) == set(range(10)) and (5000, 0) in fewer


def test_sharding_odd_rows(spark, odd, none):
    assert sharding.shard(none)[0].count() == 0
    rows = sharding.shard(odd.withColumns({x: F.lit("y") for x in ("slot", "piece", "shard", "place", "base")}), 3)[0].collect()
    assert len(rows) == odd.count()
    null = next(r for r in rows if r["doc_id"] == 1)
    assert (null["size"], null["text_crc32"]) == (8, 0)


# 11


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    from tessera.llm.encoder import vocabulary

    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.piece_model())


def whole(both, text):
    """(A ids, B ids, their bytes) of a whole text, by the libraries alone."""
    a, b = both
    if not text:
        return [], [], [], []
    shown = {chr(c): i for i, c in alignment.SHOWN.items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        p = b.id_to_piece(i)
        bytes_b.append(bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    return ids_a, ids_b, bytes_a, bytes_b


def brute_alignment(both, texts):
    found, counts = [], Counter()
    for text in texts:
        ids_a, ids_b, bytes_a, bytes_b = whole(both, text)
        spans = []
        for ids, raw in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, out = 0, []
            for i, x in zip(ids, raw, strict=True):
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links, low = [], 0
        for s, e, i in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        bounds = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = []
        for lo, hi in zip([0, *bounds], bounds, strict=False):
            groups.append("|".join(",".join(str(i) for s, e, i in one if lo <= s and e <= hi) for one in spans))
        counts.update(links)
        found.append((len(ids_a), len(ids_b), links, groups))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(n_a, n_b, len(g), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), ";".join(g)) for n_a, n_b, links, g in found]


HARD = [
    None, "", " ", "  ", "a ", " a", "a  ", "\n", "a\n b\n\n  c \n", "tab\t here\t\t x", "naïve café — “quoted” 字漢字 かな 한국어", "😀😀 a😀b", "<|endoftext|> x <s> </s> <unk> <0x0A>", "▁ blank ▁a", "a ▁▁b c",
    "nbsp  here   em 　x", "x\x00y \x1f z \x0b\x0c w", "don't we'll 'tis 12345 3.14 a1b2 --- ... ?!", "word " * 400, "字" * 500, "é ﬁ ½ ﻿ bom", "end with space \n ",
]


def as_rows(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in df.collect()}


@pytest.mark.parametrize("sent", [0, 40, alignment.PAIRS])
def test_alignment_of_hard_texts_equals_whole_texts(spark, both, sent):
    rows = list(enumerate(HARD * 2))
    mine = as_rows(alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sent_pairs=sent))
    theirs = brute_alignment(both, [t for _, t in rows])
    assert mine == dict(enumerate(theirs))


def test_alignment_query_equals_whole_texts(spark, folder, both):
    mine = {r["doc_id"]: r for r in queries.QUERIES["op11_alignment"](spark, folder).collect()}
    listed = texts_of(folder)
    for (doc_id, _), x in zip(listed, brute_alignment(both, [t for _, t in listed]), strict=True):
        r = mine.pop(doc_id)
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == x[:6]
        assert r["groups_sha256"] == (hashlib.sha256(x[6].encode()).hexdigest() if x[0] else "")
    assert not mine


def test_alignment_forgets(both, monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = [f"some word{i} and café{i % 7} {i}" for i in range(300)]
    monkeypatch.setattr(alignment, "PIECES", 50)
    monkeypatch.setattr(alignment, "TEXTS", 200)
    alignment._aligners.clear()
    total = Counter()
    for batch in alignment._count(None, None)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        for pair, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[pair] += n
    alignment._aligners.clear()
    sums = brute_alignment(both, texts)
    assert sum(total.values()) == sum(x[3] for x in sums)
    assert sum(n * n for n in total.values()) == sum(x[5] for x in sums)
    assert len(np.unique(list(total))) == len(total)


def test_alignment_odd_rows(spark, odd, none):
    assert alignment.align(none).count() == 0
    rows = alignment.align(odd.withColumns({x: F.lit("y") for x in ("pair", "rare", "groups", "n")})).collect()
    assert len(rows) == odd.count()
    assert next(r for r in rows if r["doc_id"] == 1)["n_links"] == 0


def test_new_queries_keep_extra_columns_out(spark, none):
    assert none.schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()
