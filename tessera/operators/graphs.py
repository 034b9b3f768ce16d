"""Graphs as edge tables (src, dst), and operators that run to a fixpoint with their lineage cut each round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType

from ..plans.tables import Rounds, write_once

#: Most rounds of an operator that runs to a fixpoint; reaching it is an error.
ROUNDS = 1000


def symmetrized(edges: DataFrame) -> DataFrame:
    """The edges in both directions."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices (id)."""
    ends = vertices.select("id").distinct()
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def without_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges that touch none of the vertices."""
    ends = vertices.select("id").distinct()
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_anti").join(ends.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def edge_cut(edges: DataFrame, side: DataFrame) -> DataFrame:
    """Edges with one end among the vertices of a side."""
    flags = side.select("id").distinct().withColumn("__in", F.lit(True))
    both = edges.join(flags.select(F.col("id").alias("src"), F.col("__in").alias("__s")), "src", "left").join(flags.select(F.col("id").alias("dst"), F.col("__in").alias("__d")), "dst", "left")
    return both.where(F.col("__s").isNull() != F.col("__d").isNull()).select(*edges.columns)


def line_graph(edges: DataFrame) -> DataFrame:
    """Pairs of edge ids (eid, src, dst) that share a vertex, the smaller first."""
    ends = edges.select("eid", F.explode(F.array_distinct(F.array("src", "dst"))).alias("v"))
    return ends.alias("x").join(ends.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.eid") < F.col("y.eid"))).select(F.col("x.eid").alias("a"), F.col("y.eid").alias("b")).distinct()


def walks(edges: DataFrame, n: int) -> DataFrame:
    """(src, dst, n): how many walks of n steps there are, multiplying counts rather than listing walks."""
    out = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    step = out.select(F.col("src").alias("__mid"), F.col("dst").alias("__to"), F.col("n").alias("__k"))
    for _ in range(n - 1):
        out = out.join(step, out["dst"] == step["__mid"]).groupBy("src", F.col("__to").alias("dst")).agg(F.sum(F.col("n") * F.col("__k")).alias("n"))
    return out


def to_fixpoint(first: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Apply a step until it adds no row; each round's new rows alone go into the next (semi-naive), written to the shared folder."""
    known = Rounds(first.sparkSession, first.schema, "fixpoint")
    new = known.add(first.distinct())
    for _ in range(rounds):
        new = known.add(step(new).join(known.all(), first.columns, "left_anti").distinct())
        if not new.limit(1).count():
            return known.all()
    raise ValueError(f"no fixpoint after {rounds} rounds")


def squared(pairs: DataFrame) -> DataFrame:
    """The closure of pairs by squaring: each round doubles the steps covered, so a path of n steps takes log2(n) rounds."""
    known, n = write_once(pairs), None
    for _ in range(ROUNDS):
        size = known.count()
        if size == n:
            return known
        hop = known.select(F.col("src").alias("__mid"), F.col("dst").alias("__to"))
        longer = known.join(hop, known["dst"] == hop["__mid"]).select("src", F.col("__to").alias("dst"))
        known, n = write_once(known.unionAll(longer).distinct()), size
    raise ValueError(f"no fixpoint after {ROUNDS} rounds")


def shortest_paths(edges: DataFrame, root: int) -> DataFrame:
    """(id, steps, path): a shortest path from a root to each vertex, its vertices in order; among equals the smallest predecessor's.

    Breadth first: a round adds the vertices that it reaches with their predecessors. Paths are put together
    last, round by round, each from its predecessor's.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    hop = write_once(edges.select("src", "dst").distinct())
    first = spark.range(1).select(F.lit(root).cast(kind).alias("id"), F.lit(0).alias("steps"), F.lit(None).cast(kind).alias("before"))
    seen = Rounds(spark, first.schema, "reached")
    frontier, layers = seen.add(first), []
    for steps in range(1, ROUNDS):
        layers.append(frontier)
        reached = frontier.join(hop, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("src").alias("before"))
        frontier = seen.add(reached.join(seen.all().select(F.col("id").alias("to")), "to", "left_anti").select(F.col("to").alias("id"), F.lit(steps).alias("steps"), "before"))
        if not frontier.limit(1).count():
            break
    else:
        raise ValueError("too many steps")
    last = layers[0].select("id", "steps", F.array("id").alias("path"))
    paths = Rounds(spark, last.schema, "paths")
    last = paths.add(last)
    for layer in layers[1:]:
        way = last.select(F.col("id").alias("before"), F.col("path").alias("way"))
        last = paths.add(layer.join(way, "before").select("id", "steps", F.concat("way", F.array("id")).alias("path")))
    return paths.all()


def witness_paths(edges: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(src, dst, steps, path): for each pair (src, dst) with a path, a shortest one; for src = dst the path without an edge.

    Breadth first for all pairs together, from the ends of which there are fewer different ones, the roots: pairs that
    share a root share its search, and a root whose pairs are all found goes no further. Edges are dealt to buckets once;
    a round moves what is new between the buckets (`searches`). Paths are read off backwards, one round after another for
    all pairs: before each vertex stands the smallest one that its root reached in the round before.
    """
    from . import searches
    from .relations import ordinal

    kind = edges.schema["src"].dataType
    hop = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    ends = write_once(pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    kinds = {c: ends.schema[c].dataType for c in ends.columns}
    names = None
    if not all(isinstance(f.dataType, IntegralType) for f in [*hop.schema, *ends.schema]):
        # other ids go by their numbers in order
        every = hop.select(F.col("src").alias("id")).unionAll(hop.select("dst")).unionAll(ends.select("src")).unionAll(ends.select("dst"))
        names = write_once(ordinal(every.distinct(), "id", name="name"))
        hop, ends = (df.join(names.select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")) for df in (hop, ends))
    hop, ends = (write_once(df.select(F.col("src").cast("long"), F.col("dst").cast("long"))) for df in (hop, ends))
    n_src, n_dst = ends.agg(F.count_distinct("src"), F.count_distinct("dst")).first()
    start, goal = ("src", "dst") if n_src <= n_dst else ("dst", "src")
    numbered = ordinal(ends.select(F.col(start).alias("root")).distinct(), "root", name="number")
    wants = write_once(ends.select(F.col(start).alias("root"), F.col(goal).alias("goal")).join(numbered, "root").select("goal", "root", "number"))
    whole = searches.paths(hop.select(F.col(start).alias("v"), F.col(goal).alias("w")), wants, rounds)
    if start == "dst":
        whole = whole.select(F.reverse("path").alias("path"))
    if names is not None:
        own = write_once(whole.withColumn("pair", F.struct(F.get("path", F.lit(0)).alias("a"), F.element_at("path", -1).alias("z"))))
        named = own.select("pair", F.posexplode("path").alias("i", "name")).join(names, "name").groupBy("pair")
        whole = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("path"))
    first, last = F.get("path", F.lit(0)).cast(kinds["src"]), F.element_at("path", -1).cast(kinds["dst"])
    return whole.select(first.alias("src"), last.alias("dst"), (F.size("path") - 1).alias("steps"), F.col("path").cast(ArrayType(kind)).alias("path"))


def weighted_distances(edges: DataFrame, root: int) -> DataFrame:
    """(id, weight): the least sum of weights over the paths from a root; edges (src, dst, weight) with weights of 0 or more."""
    kind = edges.schema["src"].dataType
    known = new = write_once(edges.sparkSession.range(1).select(F.lit(root).cast(kind).alias("id"), F.lit(0).cast("decimal(38,2)").alias("weight")))
    hop = edges.select("src", "dst", F.col("weight").cast("decimal(38,2)").alias("w"))
    for _ in range(ROUNDS):
        found = new.join(hop, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("weight") + F.col("w")).cast("decimal(38,2)").alias("weight"))
        # only what got nearer goes on
        old = known.select("id", F.col("weight").alias("was"))
        new = write_once(found.join(old, "id", "left").where("was IS NULL OR weight < was").select("id", "weight"))
        if not new.limit(1).count():
            return known
        known = write_once(known.unionAll(new).groupBy("id").agg(F.min("weight").alias("weight")))
    raise ValueError("too many rounds")


def complement(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The pairs of different vertices (id) without an edge between them; as many as vertices squared, which is its feature."""
    a, b = vertices.select(F.col("id").alias("src")), vertices.select(F.col("id").alias("dst"))
    return a.join(b, F.col("src") != F.col("dst")).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(src, dst): what is reached in one or more steps, from the roots (id) alone if given."""
    pairs = edges.select("src", "dst").distinct()
    if roots is None:
        return squared(pairs)
    first = pairs.join(roots.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    hop = pairs.select(F.col("src").alias("__mid"), F.col("dst").alias("__to"))
    return to_fixpoint(first, lambda new: new.join(hop, new["dst"] == hop["__mid"]).select("src", F.col("__to").alias("dst")))


def distances(edges: DataFrame, root: int) -> DataFrame:
    """(id, steps): fewest steps from a root, breadth first."""
    hop = write_once(edges.select("src", "dst").distinct())
    first = edges.sparkSession.range(1).select(F.lit(root).cast(edges.schema["src"].dataType).alias("id"), F.lit(0).alias("steps"))
    seen = Rounds(edges.sparkSession, first.schema, "reached")
    frontier = seen.add(first)
    for steps in range(1, ROUNDS):
        frontier = seen.add(frontier.join(hop, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.all().select("id"), "id", "left_anti").withColumn("steps", F.lit(steps)))
        if not frontier.limit(1).count():
            return seen.all()
    raise ValueError("too many steps")


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex that is connected, by alternating large and small stars."""
    cur, old = write_once(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()), None
    loops = cur.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    cur = cur.where("u > v")
    for _ in range(ROUNDS):
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = write_once(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        mark = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == old:
            stars = cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
            heads = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return stars.unionAll(heads).unionAll(loops.join(stars.unionAll(heads), "id", "left_anti"))
        old = mark
    raise ValueError("too many rounds")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex that is reached from and reaches it.

    Vertices without an edge in or without one out are trimmed, as they are components by themselves. What is
    left takes the colour of the smallest vertex that reaches it; a vertex of its own colour is a pivot, and
    what reaches it within its colour is its component. Components go, edges between colours as well, and the
    rest begins again. Every table is as long as the vertices or the edges; no closure is made.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    live = write_once(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    ids = live.select(F.col("src").alias("id")).unionAll(live.select(F.col("dst").alias("id"))).distinct()
    done = Rounds(spark, ids.select("id", F.col("id").alias("component")).schema, "strong")
    live = write_once(live.where("src <> dst"))
    for _ in range(ROUNDS):
        # trim: only edges whose source has an edge in and whose target has one out can be on a cycle
        size = live.count()
        while size:
            inner = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            live, before = write_once(inner.select("src", "dst")), size
            size = live.count()
            if size > 0.9 * before:
                break
        if not size:
            rest = ids.join(done.all().select("id"), "id", "left_anti") if done.n else ids
            done.add(rest.select("id", F.col("id").alias("component")))
            return done.all()
        colour = _least_reaching(live)
        same = live.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").where("c = d").select("src", "dst", "c")
        live = write_once(same)
        # backwards from the pivots, within their colour
        first = colour.where("id = c").select("id", "c")
        found = Rounds(spark, first.schema, "behind")
        front = found.add(first)
        while front.limit(1).count():
            back = live.join(front.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            front = found.add(back.join(found.all().select("id"), "id", "left_anti"))
        gone = done.add(found.all().select("id", F.col("c").cast(kind).alias("component")))
        live = write_once(live.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    raise ValueError("too many rounds")


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(id, c): the smallest vertex from which one is reached, itself included; only what changed goes on."""
    ids = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    state = new = write_once(ids.select("id", F.col("id").alias("c")))
    for _ in range(ROUNDS):
        told = new.join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("c").alias("told"))
        both = state.join(told.withColumnRenamed("dst", "id"), "id", "left")
        state = write_once(both.select("id", F.least("c", "told").alias("c"), (F.col("told") < F.col("c")).alias("changed")))
        new = state.where("changed").select("id", "c")
        state = state.select("id", "c")
        if not new.limit(1).count():
            return state
    raise ValueError("too many rounds")


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): a topological order by levels of an edge table from a thing to what it needs; a cycle is an error."""
    ids = write_once(edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct())
    left, out, level = ids, None, 0
    need = write_once(edges.select("src", "dst").distinct())
    while left.limit(1).count():
        waits = need.join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        ready = left.join(waits, "id", "left_anti")
        done = write_once(ready.withColumn("level", F.lit(level)))
        if not done.limit(1).count():
            raise ValueError("the edges have a cycle")
        out = done if out is None else out.unionAll(done)
        left, level = write_once(left.join(done, "id", "left_anti").select("id")), level + 1
    return out if out is not None else ids.withColumn("level", F.lit(0))


def merkle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, digest): a hash of each node's content and of its needs' hashes, level by level; NULL where a need is missing anywhere below."""
    nodes = write_once(nodes.select("id", "content"))
    missing = edges.join(nodes, edges["dst"] == nodes["id"], "left_anti").select(F.col("src").alias("id"), F.lit(True).alias("lost")).distinct()
    inner = write_once(edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"))
    order = levels(inner.unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0))) if inner.limit(1).count() else None
    placed = nodes.join(order, "id", "left") if order is not None else nodes.withColumn("level", F.lit(0))
    placed = write_once(placed.join(missing, "id", "left").withColumn("level", F.coalesce("level", F.lit(0))))
    top = placed.agg(F.max("level")).first()[0]
    done = None
    for level in range((top or 0) + 1):
        here = placed.where(F.col("level") == level)
        if done is None:
            made = here.withColumn("parts", F.lit("")).withColumn("bad", F.coalesce("lost", F.lit(False)))
        else:
            below = inner.join(done, inner["dst"] == done["id"]).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("parts"), F.bool_or(F.col("digest").isNull()).alias("bad"))
            made = here.join(below, here["id"] == below["src"], "left").withColumn("bad", F.coalesce("lost", F.lit(False)) | F.coalesce("bad", F.lit(False))).withColumn("parts", F.coalesce("parts", F.lit("")))
        hashed = made.select("id", F.when(~F.col("bad"), F.md5(F.concat_ws("|", F.regexp_replace("content", "\r\n", "\n"), "parts"))).alias("digest"))
        done = write_once(hashed if done is None else done.unionAll(hashed))
    return done if done is not None else nodes.select("id", F.lit(None).cast("string").alias("digest"))


def girth(edges: DataFrame) -> int:
    """The length of the shortest cycle of a simple graph, 0 if there is none: walks from each edge that never turn straight back, one step more a round.

    No shortest cycle has more steps than there are vertices, so that is where the search ends; in a graph
    without cycles it ends when no walk goes on. More than ROUNDS rounds are an error.
    """
    und = write_once(symmetrized(edges.where("src <> dst")))
    most = und.select("src").distinct().count()
    hop = und.select(F.col("src").alias("__mid"), F.col("dst").alias("__to"))
    state = write_once(und.where("src < dst").select(F.col("src").alias("root"), F.col("src").alias("prev"), F.col("dst").alias("at")))
    for n in range(2, most + 1):
        if n > ROUNDS:
            raise ValueError(f"no cycle of up to {ROUNDS} steps, and walks that go on")
        state = write_once(state.join(hop, state["at"] == hop["__mid"]).where("__to <> prev").select("root", F.col("at").alias("prev"), F.col("__to").alias("at")).distinct())
        if state.where("at = root").limit(1).count():
            return n
        if not state.limit(1).count():
            return 0
    return 0


def incidence(edges: DataFrame) -> DataFrame:
    """(v, src, dst): the ones of the vertex x edge matrix, an edge named by its ends; a loop has one."""
    return edges.select("src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("v")).select("v", "src", "dst")


def height(edges: DataFrame) -> DataFrame:
    """(height): the vertices of a longest chain of an order whose pairs (smaller, greater) are the edges, 0 without pairs; a cycle is an error."""
    return levels(edges).agg((F.coalesce(F.max("level"), F.lit(-1)) + 1).cast("long").alias("height"))


def in_dependency_order(edges: DataFrame) -> DataFrame:
    """(pos, id): each vertex once, after all that it needs; among equals by id. Edges go from a thing to what it needs."""
    from .relations import ordinal

    return ordinal(levels(edges), "level", "id").select("pos", "id")


def intersections(sets: DataFrame) -> DataFrame:
    """(members): the closure under finite intersection of sets given as sorted arrays (members), the sets themselves included.

    It can have as many sets as there are combinations, which is its feature; each round meets the new sets
    with the given ones only.
    """
    base = write_once(sets.select("members").distinct())
    given = base.select(F.col("members").alias("__other"))
    return to_fixpoint(base, lambda new: new.join(given, F.col("members") != F.col("__other")).select(F.array_sort(F.array_intersect("members", "__other")).alias("members")).distinct())
