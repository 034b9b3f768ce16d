"""The pattern index against a matcher that goes through one term and one pattern at a time."""

import random

from pyspark.sql import functions as F

from tessera.operators import patterns as P


def tree(rng, depth):
    k = 0 if depth == 0 else rng.choice([0, 0, 1, 2, 3])
    return [(rng.choice("abc"), k), *[x for _ in range(k) for x in tree(rng, depth - 1)]]


def end_of(term, i):
    left = 1
    while left:
        left += term[i][1] - 1
        i += 1
    return i


def holed(rng, term):
    out, i = [], 0
    while i < len(term):
        if i and rng.random() < 0.3:
            out.append(("*", 0, rng.randint(0, 1)))
            i = end_of(term, i)
        else:
            out.append((*term[i], None))
            i += 1
    return out


def fits(term, pattern, whole):
    i, held, score = 0, {}, 0
    for sym, arity, hole in pattern:
        if i >= len(term):
            return None
        if hole is None:
            if (sym, arity) != term[i]:
                return None
            i, score = i + 1, score + 1
        else:
            j = end_of(term, i)
            if hole in held:
                if held[hole] != term[i:j]:
                    return None
                score += 1
            held.setdefault(hole, term[i:j])
            i = j
    return score if i == len(term) or not whole else None


def test_terms_fit_as_one_by_one(spark):
    rng = random.Random(3)
    terms = [tree(rng, 3) for _ in range(150)]
    patterns = [holed(rng, rng.choice(terms)) for _ in range(80)] + [[]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(terms)] + [(900, None), (901, [])], f"term_id long, tokens {P.TOKENS}")
    index = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, tokens array<struct<sym:string,arity:int,hole:int>>")
    for whole in (True, False):
        found = sorted((r["term_id"], r["pattern_id"], r["score"]) for r in P.matches(rows, index, whole).collect())
        wanted = [(i, j, s) for i, t in enumerate(terms) for j, p in enumerate(patterns) if p and (s := fits(t, p, whole)) is not None]
        assert found == sorted(wanted) and len(found) > 200


def test_a_large_trie_is_joined_by_a_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    terms = [tree(rng, 2) for _ in range(40)]
    patterns = [holed(rng, t) for t in terms]
    rows = spark.createDataFrame(list(enumerate(terms)), f"term_id long, tokens {P.TOKENS}")
    index = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, tokens array<struct<sym:string,arity:int,hole:int>>")
    once = sorted(map(str, P.matches(rows, index).collect()))
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    assert sorted(map(str, P.matches(rows, index).collect())) == once


def test_ends_of_terms_and_empty_index(spark):
    df = spark.createDataFrame([(0, [("f", 2), ("a", 0), ("g", 1), ("b", 0)]), (1, [("a", 0), ("b", 0)])], f"term_id long, tokens {P.TOKENS}")
    assert [r[0] for r in df.select(P.ends(F.col("tokens"))).collect()] == [[4, 2, 4, 4], [1, 2]]
    none = spark.createDataFrame([], "pattern_id long, tokens array<struct<sym:string,arity:int,hole:int>>")
    assert P.matches(df, none).count() == 0


def test_all_levels_are_one_pass(spark, monkeypatch):
    """Only the trie is written; a pattern that ends inside a longer one is found beside it."""
    written = []
    monkeypatch.setattr(P, "write_once", lambda df, keep=P.write_once: written.append(df) or keep(df))
    a, b, hole = ("a", 0, None), ("b", 0, None), ("*", 0, 0)
    index = spark.createDataFrame(list(enumerate([[a], [a, b], [a, hole, b], [a, hole, hole, a]])), "pattern_id long, tokens array<struct<sym:string,arity:int,hole:int>>")
    rows = spark.createDataFrame([(0, "abb"), (1, "abba"), (2, "aa"), (3, "ba")], "term_id long, w string")
    terms = rows.select("term_id", P.words(F.regexp_replace("w", "(.)", "$1 ")).alias("tokens"))
    found = sorted((r["term_id"], r["pattern_id"], r["score"]) for r in P.matches(terms, index, whole=False).collect())
    assert found == [(0, 0, 1), (0, 1, 2), (0, 2, 2), (1, 0, 1), (1, 1, 2), (1, 2, 2), (1, 3, 3), (2, 0, 1)]
    assert len(written) == 2
