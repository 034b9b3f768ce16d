"""The index of repeated substrings that is kept in the shared folder: batch after batch equals everything at once."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.substring_levels import LENGTH, SubstringIndex

from .conftest import DOCS, ODD
from .test_operators import brute_repeats, by_row, repeat_rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("extra"))


def by_id(rows):
    """In ascending order of ids, rows without one last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def results(df):
    return [tuple(r)[:5] for r in df.collect()]


def strings(index):
    found = set()
    for name, n in index.levels:
        rows = index.level(name).collect()
        assert len(rows) == n == len({(r.key, bytes(r.run)) for r in rows})
        for r in rows:
            run = bytes(r.run)
            found |= {run[i : i + LENGTH] for i in range(len(run) - LENGTH + 1)}
    return found


def test_batches_one_after_another_equal_brute_force(spark, tmp_path):
    rows = by_id(repeat_rows())
    cuts = [0, 110, 190, len(rows)]
    found, path = [], str(tmp_path / "index")
    for low, high in zip(cuts, cuts[1:], strict=False):
        # a new object each time, as another driver would have
        found += results(SubstringIndex(spark, path).add(frame(spark, rows[low:high])))
    assert sorted(found, key=by_row) == sorted(brute_repeats(rows), key=by_row)
    index = SubstringIndex(spark, path)
    assert index.version == 3
    every = {b[i : i + LENGTH] for d, t in rows if d is not None for b in [(t or "").encode()] for i in range(len(b) - LENGTH + 1)}
    assert strings(index) == every


def test_earlier_batches_come_first_whatever_their_ids(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path / "index"))
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(90))
    assert [r[2] for r in results(index.add(frame(spark, [(9, text)])))] == [0]
    assert sorted(results(index.add(frame(spark, [(1, "x" + text), (2, text[5:60])]))))[0][2] == 90
    assert [r[2] for r in results(index.add(frame(spark, [(9, text)])))] == [90]


def test_levels_merge_geometrically(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path / "index"))
    rng = random.Random(2)
    for i in range(4):
        size = [4000, 300, 60, 300][i]
        index.add(frame(spark, [(i, "".join(rng.choice("abcdefghij") for _ in range(size)))]))
        sizes = [n for _, n in index.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert len(sizes) == [1, 2, 3, 2][i]
    folders = [x for x in (tmp_path / "index").iterdir() if x.name.startswith("level-")]
    assert len(folders) == 2  # merged levels are deleted


def test_a_batch_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    text = "".join(random.Random(3).choice("abcdef ") for _ in range(200))
    SubstringIndex(spark, path).add(frame(spark, [(1, text)]))
    later = frame(spark, [(2, text[:100] + "?" * 70)])
    with monkeypatch.context() as m:
        m.setattr(SubstringIndex, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            SubstringIndex(spark, path).add(later)
    again = SubstringIndex(spark, path)
    assert again.version == 1
    assert [(r[2], r[3]) for r in results(again.add(later))] == [(100, 1)]


def test_odd_rows_and_empty_batches(spark, tmp_path, odd, none):
    index = SubstringIndex(spark, str(tmp_path / "index"))
    assert index.add(none).count() == 0
    assert index.version == 0
    rows = [(r[0], r[1]) for r in ODD]
    assert sorted(results(index.add(odd)), key=by_row) == sorted(brute_repeats(rows), key=by_row)
    assert index.add(none).count() == 0
    assert (index.version, spark.createDataFrame(ODD, DOCS).count()) == (1, len(ODD))
