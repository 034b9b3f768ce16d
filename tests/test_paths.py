"""Paths, components and fixpoints on random graphs with branches and cycles, against one machine's search."""

import random
from collections import deque

import pytest

from tessera.operators import graphs as G


def search(adjacent, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in adjacent.get(v, ()):
            if w not in seen:
                seen[w] = seen[v] + 1
                queue.append(w)
    return seen


def graph(seed, n, m):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    # a long cycle and a long way into it
    edges |= {(1000 + i, 1000 + (i + 1) % 12) for i in range(12)} | {(2000 + i, 2001 + i) for i in range(6)} | {(2006, 1000)}
    return sorted(edges)


def adjacency(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_witness_paths(spark, seed):
    edges = graph(seed, 60, 100)
    adjacent = adjacency(edges)
    vertices = sorted({v for e in edges for v in e})
    rng = random.Random(seed)
    pairs = [(rng.choice(vertices), rng.choice(vertices)) for _ in range(300)] + [(2000, 1011), (5, 5), (1000, 2000), (7777, 7777)]
    df = spark.createDataFrame(edges, "src long, dst long")
    asked = spark.createDataFrame([*pairs, pairs[0], (None, 1)], "src long, dst long")
    found = {(r["src"], r["dst"]): r for r in G.witness_paths(df, asked).collect()}
    for a, b in set(pairs):
        steps = search(adjacent, a).get(b)
        if steps is None:
            assert (a, b) not in found
            continue
        r = found.pop((a, b))
        assert r["steps"] == steps and len(r["path"]) == steps + 1
        assert r["path"][0] == a and r["path"][-1] == b
        assert all(y in adjacent[x] for x, y in zip(r["path"], r["path"][1:], strict=False))
    assert not found


@pytest.mark.parametrize("turned", [False, True])
def test_pairs_of_one_end_share_its_search(spark, monkeypatch, turned):
    """The rows of a search are at most as many as its vertices, however many pairs there are."""
    kept = []

    class Counted(G.Rounds):
        def __init__(self, spark, schema, name="rounds"):
            super().__init__(spark, schema, name)
            kept.append((name, self))

    monkeypatch.setattr(G, "Rounds", Counted)
    edges = [(a, b) if not turned else (b, a) for a, b in graph(9, 40, 70)]
    adjacent, vertices = adjacency(edges), sorted({v for e in edges for v in e})
    asked = [(2000, v) if not turned else (v, 2000) for v in vertices]
    found = G.witness_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(asked, "src long, dst long")).collect()
    assert {(r["src"], r["dst"]): r["steps"] for r in found} == {p: n for p in asked if (n := search(adjacent, p[0]).get(p[1])) is not None}
    assert len(found) > 12
    assert sum(r.all().count() for name, r in kept if name == "witness-reached") <= len(vertices)


def test_a_round_moves_what_is_new_and_not_the_edges(spark, monkeypatch):
    """Over all rounds, a search records a vertex once, sends over an edge once, and never shuffles the edges again."""
    from tessera.operators import searches

    told, whole = [], searches._Moving.add

    def add(self, df):
        out = whole(self, df)
        told.append((self.path, [(len(r["at"]) // 8, r["sent"]) for r in out.where("NOT moving AND at IS NOT NULL").select("at", "sent").collect()] if "sent" in self.schema.names else []))
        return out

    monkeypatch.setattr(searches._Moving, "add", add)
    edges = graph(9, 40, 70)
    adjacent, vertices = adjacency(edges), sorted({v for e in edges for v in e})
    found = G.witness_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(2000, v) for v in vertices], "src long, dst long")).collect()
    wanted = search(adjacent, 2000)
    assert {r["dst"]: r["steps"] for r in found} == wanted
    rows = [r for _, round_ in told for r in round_]
    assert sum(n for n, _ in rows) == len(wanted) and sum(n for _, n in rows) <= len(edges)


def test_more_roots_than_a_word_hubs_and_names(spark, monkeypatch):
    from tessera.operators import searches

    monkeypatch.setattr(searches, "SLICE", 1)
    # 70 roots reach a hub by two ways each, and the hub leads to 80 goals
    edges = [(f"r{i:02}", f"m{i % 3}") for i in range(70)] + [(f"r{i:02}", "m3") for i in range(70)] + [(f"m{i}", "hub") for i in range(4)] + [("hub", f"z{i:02}") for i in range(80)]
    asked = [(f"r{i:02}", f"z{j:02}") for i in range(70) for j in range(80) if (i + j) % 7 == 0]
    found = G.witness_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(asked, "src string, dst string")).collect()
    assert {(r["src"], r["dst"]): r["path"] for r in found} == {(a, z): [a, f"m{int(a[1:]) % 3}", "hub", z] for a, z in asked}
    assert {r["steps"] for r in found} == {3}


def test_shortest_paths_and_distances(spark):
    edges = graph(3, 50, 90)
    adjacent = adjacency(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    wanted = search(adjacent, 2000)
    assert {r["id"]: r["steps"] for r in G.distances(df, 2000).collect()} == wanted
    found = G.shortest_paths(df, 2000).collect()
    assert {r["id"]: r["steps"] for r in found} == wanted
    for r in found:
        assert len(r["path"]) == r["steps"] + 1 and r["path"][0] == 2000 and r["path"][-1] == r["id"]
        assert all(y in adjacent[x] for x, y in zip(r["path"], r["path"][1:], strict=False))


@pytest.mark.parametrize(("seed", "n", "m"), [(4, 60, 90), (5, 40, 200), (6, 80, 60)])
def test_strong_components(spark, seed, n, m):
    edges = graph(seed, n, m)
    adjacent = adjacency(edges)
    reach = {v: set(search(adjacent, v)) for v in {x for e in edges for x in e}}
    wanted = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    found = {r["id"]: r["component"] for r in G.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == wanted


def test_closure_from_roots_and_empty_graphs(spark):
    edges = graph(7, 30, 40)
    adjacent = adjacency(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    roots = spark.createDataFrame([(2000,), (edges[0][0],)], "id long")
    found = {(r["src"], r["dst"]) for r in G.closure(df, roots).collect()}
    wanted = {(a, c) for a in (2000, edges[0][0]) for b in adjacent[a] for c in search(adjacent, b)}
    assert found == wanted
    none = df.where("src < 0")
    assert G.strong_components(none).count() == 0
    assert [tuple(r) for r in G.witness_paths(none, spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")).select("src", "dst", "steps").collect()] == [(1, 1, 0)]
