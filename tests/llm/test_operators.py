"""Each operator against a brute-force version, and its defined results for odd rows."""

import datetime
import hashlib
import json
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html, jaccard, mixing, pii, quality, queries, substrings, token_counts, tokens, toxicity
from tessera.llm.encoder import Encoder

from .conftest import DOCS, ODD


def duck(folder, sql):
    c = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = c.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    columns, rows = duck(folder, queries.SQL[name])
    assert sorted(df.columns) == sorted(columns)
    key = sorted(columns)
    mine = sorted(repr([plain(r[c]) for c in key]) for r in df.collect())
    assert mine == sorted(repr([plain(r[columns.index(c)]) for c in key]) for r in rows)


# 1


def brute_segments(scores):
    """All maximal scoring segments by their definition, recursively: the best one, then left and right of it."""
    best, at = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-9 or (abs(total - best) < 1e-9 and at and b - a < at[1] - at[0] - 1):
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return [*brute_segments(scores[:a]), (a, b, best), *right]


def test_segments_equal_brute_force():
    random.seed(1)
    for _ in range(200):
        scores = [random.choice([-3, -2, -1, 1, 2, 5]) + random.random() for _ in range(random.randint(0, 14))]
        mine, theirs = toxicity.segments(scores), brute_segments(scores)
        assert [(a, b) for a, b, _ in mine] == [(a, b) for a, b, _ in theirs]
        assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(mine, theirs, strict=True))


def test_toxicity_learns_words(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = [random.choice(words) for _ in range(60)]
        if toxic:
            at = random.randrange(50)
            text[at : at + 3] = ["idiot", "stupid", "moron"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((found[i]["score"] >= 0.5) == (i % 6 == 0) for i in held)
    passages = found[next(i for i in held if i % 6 == 0)]["passages"]
    best = max(passages, key=lambda x: x["evidence"])
    assert best["stop"] - best["start"] >= 3


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(scores) == len(ODD) and len({r["score"] for r in scores}) == 1 and scores[0]["score"] < 0.5
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


# 2


def test_mix_targets_and_copies(spark):
    random.seed(3)
    rows = [(i, "w " * random.randint(1, 40), "en", random.choice(["a", "b", "c", "d", None]), 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    made = mixing.plan(docs).collect()
    by = {}
    for r in made:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
    assert abs(sum(t for t, _ in by.values()) - sum(by)) < 1e-6 * sum(by)
    for size, (target, taken) in by.items():
        assert target <= 3 * size + 1e-6 and abs(taken - target) < 0.02 * target + 40
    copies = Counter({r["doc_id"]: r["copies"] for r in made})
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == +copies
    assert sorted(map(tuple, made)) == sorted(map(tuple, mixing.plan(docs).collect()))


def test_mix_draws_rows_without_ids_one_by_one(spark):
    rows = [(None, f"text number {i}", None, "a", None) for i in range(300)] + [(i, "b " * 30, None, "b", None) for i in range(40)]
    found = [r["copies"] for r in mixing.plan(spark.createDataFrame(rows, DOCS)).collect() if r["doc_id"] is None]
    assert len(found) == 300 and len(set(found)) == 2


def test_mix_odd_rows(odd, none):
    assert mixing.plan(odd).count() == len(ODD)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


# 3


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}


def brute_components(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        find(a)
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in sets}


def near_rows(seed, sizes=(3, 5, 6, 8, 9, 12, 20, 30, 36, 40, 50, 70, 120, 300)):
    random.seed(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for n in sizes:
        for _ in range(2):
            base = [random.choice(words) for _ in range(n)]
            for _ in range(random.choice([1, 3, 12])):
                w = list(base)
                for _ in range(random.randint(0, max(1, n // 40))):
                    w[random.randrange(n)] = random.choice(words)
                if random.random() < 0.4:
                    w += [random.choice(words) for _ in range(random.randint(0, max(1, n // 8)))]
                rows.append((len(rows) * 3, " ".join(w)))
    random.shuffle(rows)
    return rows


def test_jaccard_equals_brute_force(spark):
    rows = near_rows(5)
    rows += [(None, "a b c d e f"), (5000, None), (5001, ""), (5003, "A b C d E f"), (5004, "a b c d e f"), (5004, "a b c d e f"), (5005, "X Y"), (5006, "x y")]
    rows.append((rows[0][0], rows[20][1]))  # an id with two texts
    expected = brute_components(rows)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["component_id"] == expected.get(r["doc_id"])


def test_jaccard_without_first_links(spark, monkeypatch):
    """A family whose members are near the first one but not linked to it: what the hubs and the shared signatures must find."""
    random.seed(9)
    words = [f"w{i}" for i in range(5000)]
    base = [random.choice(words) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for at in random.sample(range(200), random.choice([1, 6, 12])):
            w[at] = random.choice(words)
        rows.append((i, " ".join(w)))
    expected = brute_components(rows)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_jaccard_family_of_families(spark, monkeypatch):
    """A hub whose members form families of families, in more runs than one, and bins compared a few at a time."""
    monkeypatch.setattr(jaccard, "BLOCK", 25)
    monkeypatch.setattr(jaccard, "AT_ONCE", 2000)
    random.seed(14)
    words = [f"w{i}" for i in range(20000)]
    base = [random.choice(words) for _ in range(240)]

    def edited(w, n):
        w = list(w)
        for at in random.sample(range(len(w)), n):
            w[at] = random.choice(words)
        return w

    rows = []
    for size in (90, 30, 12):
        branch = edited(base, 14)
        for _ in range(3):
            twig = edited(branch, 7)
            rows += [(7 * len(rows) + i, " ".join(edited(twig, random.choice([0, 1, 3, 6])))) for i in range(size // 3)]
    random.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows)


def test_sets_with_too_few_segments(spark, monkeypatch):
    """With segments chosen just above need, sets lack some; their one-deletion neighbourhoods find the links then."""
    monkeypatch.setattr(jaccard, "MARGIN", 0.0)
    jaccard.segments_of.cache_clear()
    try:
        rows = near_rows(15, (33, 36, 40, 50, 70))
        found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        lacking = [s for s in (jaccard.shingles(t) for _, t in rows) if jaccard.segments_of(jaccard.band(len(s))[2]) and len(jaccard.signatures(s, *jaccard.band(len(s))[::2])) < len(s) // 4 + 1]
    finally:
        jaccard.segments_of.cache_clear()
    assert lacking and {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows)


def test_one_deletion_neighbourhoods_find_what_segments_miss():
    random.seed(4)
    for n in (40, 100):
        number, _, high = jaccard.band(n)
        m = jaccard.segments_of(high)
        s = np.sort(np.array([random.getrandbits(64) for _ in range(n)], np.uint64))
        t = np.delete(s, random.randrange(n))
        chosen = frozenset(range(m))
        exact = set(jaccard.signatures(t, number, high).tolist())
        gone = set(jaccard.signatures(s, number, high).tolist()) - exact
        assert len(gone) == 1 and set(jaccard.neighbourhood(s, number, high, chosen).tolist()) & exact


def test_jaccard_keep_one_and_odd_rows(odd, none):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_jaccard_copy_without_id_first(spark):
    """A row without an id ahead of an equal one in a task must not take its signatures along."""
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-1], "other"]
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert found == {None: None, 1: 1, 2: 1}


# 4

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>A</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>%s<aside>Side</aside><section class="comments"><p>I like it very much indeed, thank you</p></section><form><input> Send <button>Go</button></form><footer>&copy; x</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>One  two\nthree <b>four</b> &eacute;<br>five" + " word" * 40 + "</p><p>short</p><ul><li>a<li>b</ul>" + "<p>" + "more text " * 30 + "</p>"
TEXT = "Head & line\nOne two three four é five" + " word" * 40 + "\nshort\na\nb\n" + ("more text " * 30).strip()


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="post-content">%s</div>'])
def test_html_article(wrap):
    assert html.extract(PAGE % (wrap % BODY)) == TEXT


def test_html_without_marks():
    found = html.extract(PAGE % f"<div id=content>{BODY}</div>").split("\n")
    assert "short" in found and "Head & line" in found and not {"Site", "A", "Buy", "Side", "We use cookies"} & set(found)


def test_html_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>only"), (None, "u", "plain"), (4, "u", "<article>" + "<p>x &lt; y</p>" * 20000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("extra"))
    found = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert [found[i]["text"] for i in (1, 2, 3, None)] == ["", "", "only", "plain"]
    assert found[4]["text"] == "\n".join(["x < y"] * 20000) and found[4]["n_chars"] == 6 * 20000 - 1


def test_html_chunks_do_not_matter(monkeypatch):
    whole = html.extract(PAGE % f"<article>{BODY}</article>")
    monkeypatch.setattr(html, "CHUNK", 7)
    assert html.extract(PAGE % f"<article>{BODY}</article>") == whole


@pytest.mark.parametrize(
    "wrap",
    [
        "<div class='layout has-sidebar'><article>%s</article></div>",
        "<main class='with-sidebar'>%s</main>",
        "<article class='post category-legal'>%s</article>",
        "<article class='post' id=sponsored>%s</article>",
        "<div class='content-sidebar-wrap'><main>%s</main></div>",
        "<div class=overlay><article>%s</article></div>",
        "<div class='sidebar'><article>%s</article></div>",
    ],
)
def test_html_hints_never_drop_the_article(wrap):
    assert html.extract(PAGE % (wrap % BODY)) == TEXT


def test_html_inline_elements_nest():
    inner = "<p>Text <span class=ad>Buy <span>now</span> this advert</span> goes <b>on <b>and</b> on</b>.</p><p>More <label>words</label></p>"
    assert html.extract(f"<article>{inner}</article>").split("\n") == ["Text", "goes on and on.", "More words"]


def test_html_deep_nesting_is_linear():
    import time

    began = time.process_time()
    assert html.extract("<div>" * 50000 + "x" + "</i>" * 50000 + "</div>" * 50000) == "x"
    assert time.process_time() - began < 20


def test_html_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(empty).count() == 0
    rows = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (1, "u", "<p>b")], "page_id long, url string, html string").withColumn("k", F.lit("extra"))
    assert sorted(r["text"] for r in html.main_text(rows).collect()) == ["a", "a", "b"]


def test_html_entries_of_others_stay_out():
    others = "<div class='comments-area'><article class=comment><p>Nice words</p></article></div><div class='related-posts'><article><p>Other page</p></article></div>"
    assert html.extract(PAGE % (f"<article>{BODY}</article>{others}")) == TEXT


# 5


def test_quality_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 10 else bad, "en", "fine", 0) for i in range(100)] + [(100 + i, good if i % 10 == 0 else bad, "en", "poor", 0) for i in range(100)]
    rows += [(300 + i, good, "en", f"h{i % 5}", 0) for i in range(50)] + [(400, good, "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert all(found[i] == bool(i % 10) for i in range(100))
    assert not any(found[i] for i in range(100, 200)) and all(found[i] for i in range(300, 350)) and found[400]
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == {k for k, v in found.items() if v}


def test_quality_suspect_hosts(spark):
    """Documents with many symbols go at the one host where they are common, and stay where they are rare; the same by duplicate lines."""
    plain_text = " ".join(f"word{i}" for i in range(60))
    signs, lines = plain_text + " # # # # # # #", "\n".join([plain_text, "again", "again", "again"])
    rows = [(100 * h + i, signs if i < (60 if h == 3 else 2) else lines if i >= (50 if h == 4 else 98) else plain_text, "en", f"h{h}", 0) for h in range(12) for i in range(100)]
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    gone = {d for d, t, _, h, _ in rows if (h == "h3" and t == signs) or (h == "h4" and t == lines)}
    assert {d for d, r in found.items() if not r["kept"]} == gone and not any(r["base_failed"] for r in found.values())


def test_quality_odd_rows(odd, none):
    assert quality.judge(odd).count() == len(ODD)
    assert quality.keep(odd).columns == odd.columns
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0


# 6


def test_containment_equals_brute_force(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice([3, 5, 12, 30, 60])))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        w = [random.choice(words) for _ in range(random.randint(0, 200))]
        if random.random() < 0.5:
            part = items[random.randrange(30)][1].split()
            for at in random.sample(range(len(part)), random.randint(0, max(0, len(part) // 20))):
                part[at] = "x"
            cut = random.randint(0, len(part) // 5)
            at = random.randint(0, len(w))
            w[at:at] = part[cut:]
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[3][1]), (502, items[3][1])]

    def sets(text, k):
        w = (text or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    expected = set()
    for i, t in items:
        k = min(5, len((t or "").split()))
        q = sets(t, k) if k else set()
        expected |= {(d, i) for d, x in docs if q and 100 * len(q & sets(x, k)) >= 80 * len(q)}
    documents = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("extra"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in decontaminate.search(documents, benchmark).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    leaks = {t for d, t in docs if d in {x for x, _ in expected}}
    clean = decontaminate.clean(documents, benchmark)
    assert clean.columns == documents.columns
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(str(t) for _, t in docs if t not in leaks)


def test_containment_by_shuffle_equals_broadcast(spark, folder, monkeypatch):
    docs, items = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.search(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert whole and sorted(map(tuple, decontaminate.search(docs, items).collect())) == whole


def test_containment_is_native(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "benchmark"))
    plan = decontaminate.search(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_containment_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.search(none, some).count() == 0 and decontaminate.search(none, items).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_containment_of_items_without_or_with_repeated_ids(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    items = spark.createDataFrame([(None, a), (1, b), (1, c), (1, c), (2, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (3, f"x {c} y"), (4, f"{b} {c}"), (5, "x y z")], "doc_id long, text string")
    found = [tuple(r) for r in decontaminate.search(docs, items).collect()]
    assert sorted(found, key=str) == sorted([(1, None, 8, 8), (2, 1, 8, 8), (2, 2, 8, 8), (3, 1, 8, 8), (4, 1, 8, 8), (4, 1, 8, 8), (4, 2, 8, 8)], key=str)
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [5]


# 7


def luhn(s):
    total = 0
    for i, c in enumerate(reversed([int(x) for x in s if x.isdigit()])):
        total += c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c)
    return total % 10 == 0


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymize(df, key).orderBy("doc_id").collect()]


def test_pii_formats(spark):
    texts = ["4111 1111 1111 1111", "4111111111111111", "4111111111111112", "64.147.79.24", "300.1.1.1", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001", "1984-02-29", "2020-13-40", "078-05-1120", "666-12-3456", "+1 (171) 555-2028", "a.b24@mail4.example.com", None, "", "no numbers here", "3/14/1999", "31.12.2001"]
    out = dict(zip(texts, replaced(spark, texts), strict=True))
    for same in ("4111111111111112", "300.1.1.1", "DE89370400440532013001", "2020-13-40", "666-12-3456", None, "", "no numbers here"):
        assert out[same] == same
    for new in set(texts) - {"4111111111111112", "300.1.1.1", "DE89370400440532013001", "2020-13-40", "666-12-3456", None, "", "no numbers here"}:
        assert out[new] != new and len(out[new]) in (len(new), len(new) - 1, len(new) + 1, len(new) - 4, len(new) + 4)
    assert out["4111 1111 1111 1111"].replace(" ", "") == out["4111111111111111"] and luhn(out["4111111111111111"])
    account = out["DE89370400440532013000"]
    assert account[:2] == "DE" and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    assert out["+1 (171) 555-2028"].startswith("+1 (") and out["a.b24@mail4.example.com"].endswith("@mail4.example.com")


def test_pii_links_and_permutes(spark):
    texts = [f"call +1 (555) 010-{i:04d} or 10.0.{i % 256}.{i // 256}" for i in range(1500)]
    out = replaced(spark, texts)
    assert len(set(out)) == len(texts)
    assert replaced(spark, ["x " + texts[7] + " y"])[0] == "x " + out[7] + " y"
    assert replaced(spark, ["4111111111111111 on 1984-02-29"]) == ["9946067425559066 on 2027-05-05"]
    assert replaced(spark, texts[:5], "other") != out[:5]
    days = replaced(spark, [f"{1990 + i // 365}-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(1000)])
    assert all(len(x) == 10 for x in days)


def test_pii_long_texts_and_runs(spark):
    """Long runs of whatever a pattern repeats take no deep stack, and leave what is no value; names of any length go."""
    runs = ["x@" + "a." * 20000, "x@" + "ab." * 20000 + "org", "a" * 50000 + "@x.org", "1" * 50000, "1." * 20000]
    out = replaced(spark, runs)
    assert out[1][1:] == runs[1][1:] and [out[0], *out[3:]] == [runs[0], *runs[3:]]
    assert len(out[2]) == len(runs[2]) and out[2].endswith("@x.org") and out[2].count("a") < 5000


def test_pii_many_groups_in_a_row(spark):
    """Twenty thousand digit groups in a row keep their form."""
    random.seed(7)
    text = " ".join(str(random.randint(1000, 9999)) for _ in range(20_000))
    out = replaced(spark, [text])[0]
    assert [len(x) for x in out.split(" ")] == [len(x) for x in text.split(" ")]


def test_pii_forms_are_kept(spark):
    out = replaced(spark, ["192.168.001.001", "192.168.1.1", "de89 3704 0044 0532 0130 00 then", "DE89370400440532013000", "mp34 this that word here", "...jo@x.org", "jo@x.org"])
    assert [len(x) for x in out[0].split(".")][2:] == [3, 3] and [int(x) for x in out[0].split(".")] == [int(x) for x in out[1].split(".")]
    assert out[2].endswith(" then") and out[2][:-5].upper().replace(" ", "") == out[3] and out[2] == out[2].lower()
    assert out[4] == "mp34 this that word here" and out[5] == "..." + out[6] and out[6] != "jo@x.org"


def test_pii_email_names_by_domain_and_alphabet(spark):
    """Each alphabet is permuted in itself, under the domain; all names of two letters stay apart."""
    shown = lambda x: next(((ord(a), ord(b) - ord(a) + 1) for a, b in pii.ALPHABETS if a <= x <= b), (ord(x), 1))
    names = ["josé", "Иван.К-3", "王小", "a", "Ünal_9", "x" * 200]
    for domain in ("x.org", "Y.org"):
        want = []
        for name in names:
            bases = [shown(c) for c in name]
            moved = feistel([ord(c) - b for c, (b, _) in zip(name, bases, strict=True)], [n for _, n in bases], "secret", f"email|{domain.lower()}")
            want.append("".join(chr(b + v) for (b, _), v in zip(bases, moved, strict=True)) + "@" + domain)
        assert replaced(spark, [f"{x}@{domain}" for x in names], "secret") == want
    pairs = [a + b + "@x.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    out = replaced(spark, pairs)
    assert sorted(out) == sorted(pairs)


def test_pii_dates_phones_and_ssns_equal_plain_feistel(spark):
    first, days = datetime.date(1800, 1, 1), [datetime.date(1999, 12, 31), datetime.date(2024, 2, 29), datetime.date(1800, 1, 1), datetime.date(2199, 12, 31)]
    want = []
    for d in days:
        a, b = feistel(list(divmod((d - first).days, 773)), [189, 773], "secret", "date")
        want.append((first + datetime.timedelta(a * 773 + b)).isoformat())
    assert replaced(spark, [d.isoformat() for d in days], "secret") == want
    moved = "".join(map(str, feistel([3, 0, 1, 2, 3, 4, 5, 6, 7], [10] * 9, "secret", "phone")))
    assert replaced(spark, ["+49 30 1234567"], "secret") == [f"+49 {moved[:2]} {moved[2:]}"]
    ssns, want = [(78, 5, 1120), (667, 1, 1), (899, 99, 9999)], []
    for area, group, serial in ssns:
        x, y, z = feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], "secret", "ssn")
        want.append(f"{x + (2 if x > 664 else 1):03d}-{y + 1:02d}-{z + 1:04d}")
    assert replaced(spark, ["%03d-%02d-%04d" % x for x in ssns], "secret") == want
    account = "370400440532013000"
    moved = "".join(map(str, feistel([int(c) for c in account], [10] * 18, "secret", "iban")))
    check = 98 - int(moved + "131400") % 97
    assert replaced(spark, ["DE89" + account], "secret") == [f"DE{check:02d}{moved}"]


def test_pii_phone_digits_alone_count(spark):
    forms = ["+49 30 1234567", "+49301234567", "+49-30-1234-567", "+351 21 1234567", "+351211234567", "+1 (171) 555-2028", "+11715552028"]
    found = ["".join(c for c in x if c.isdigit()) for x in replaced(spark, forms)]
    assert found[0] == found[1] == found[2] and found[0][:2] == "49" and found[3] == found[4] and found[5] == found[6]
    assert all(x != "".join(c for c in f if c.isdigit()) for x, f in zip(found, forms, strict=True))


def feistel(values, radices, key, kind):
    """The permutation in plain Python, by its definition."""
    half = len(values) // 2
    sides, bases = [list(values[:half]), list(values[half:])], [radices[:half], radices[half:]]
    for turn in range(pii.ROUNDS):
        a, b = turn % 2, 1 - turn % 2
        other = ",".join(map(str, sides[b]))
        other = hashlib.sha256(other.encode()).hexdigest() if len(sides[b]) > pii.LONG_HALF else other
        sides[a] = [(v + int(hashlib.sha256(f"{key}|{kind}|{turn}|{other}|{i}".encode()).hexdigest()[:12], 16)) % r for i, (v, r) in enumerate(zip(sides[a], bases[a], strict=True))]
    return sides[0] + sides[1]


def test_pii_equals_plain_feistel(spark):
    random.seed(16)
    ips = [[random.randrange(256) for _ in range(4)] for _ in range(40)]
    out = replaced(spark, ["at " + ".".join(map(str, x)) + " it" for x in ips], "secret")
    assert out == ["at " + ".".join(map(str, feistel(x, [256] * 4, "secret", "ip"))) + " it" for x in ips]
    cards = []
    while len(cards) < 40:
        if luhn(d := "".join(random.choice("0123456789") for _ in range(16))):
            cards.append(d)
    bodies = ["".join(map(str, feistel([int(c) for c in d[:-1]], [10] * 15, "secret", "card"))) for d in cards]
    assert replaced(spark, cards, "secret") == [next(b + c for c in "0123456789" if luhn(b + c)) for b in bodies]
    assert len({tuple(feistel([i // 10, i % 10, 3], [10] * 3, "k", "x")) for i in range(100)}) == 100


def test_pii_keeps_a_column_of_its_own_name(spark):
    df = spark.createDataFrame([(1, "call 10.0.0.1")], "doc_id long, text string").withColumn("found_kinds", F.lit("mine"))
    row = pii.pseudonymize(df, "k").first()
    assert row["found_kinds"] == "mine" and row["_found_kinds"] == ["ip"]


def test_pii_is_native_and_keeps_rows(spark, odd, none):
    out = pii.pseudonymize(odd, "k")
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "found_kinds"]
    plan = pii.pseudonymize(spark.createDataFrame(ODD, DOCS), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Pandas" not in plan and "InArrow" not in plan
    assert pii.pseudonymize(none, "k").count() == 0


def test_pii_values_beside_other_groups(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    new_card, new_iban, new_date = replaced(spark, [card, iban, "12/31/1999"])
    assert card != new_card and iban != new_iban
    forms = ["%s 12/27", "%s 123", "%s 12/27 123", "exp 12/27 %s", "12 %s 123", "1234 12 %s", "no 300.1.1.1, card %s 12", "+49 %s"]
    out = replaced(spark, [x % card for x in forms] + ["4111111111111111 123", "%s EUR" % iban, "%s PAID BACK" % iban, f"{card} 12/31/1999", f"{card} 12/27 and {card} 123", "4111 1111 1111 1112 123"])
    assert out[: len(forms)] == [x % new_card for x in forms]
    assert out[len(forms) :] == [new_card.replace(" ", "") + " 123", f"{new_iban} EUR", f"{new_iban} PAID BACK", f"{new_card} {new_date}", f"{new_card} 12/27 and {new_card} 123", "4111 1111 1111 1112 123"]


def test_pii_long_runs_of_groups_equal_plain_choice(spark):
    """Fours of groups that pass as they stand go first; between them the leftmost fours that pass, without overlaps."""

    def passes(four):
        d = [int(c) for c in reversed("".join(four))]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    random.seed(77)
    groups = [f"{random.randrange(10000):04d}" for _ in range(1500)]
    chosen = {i for i in range(0, len(groups), 4) if passes(groups[i : i + 4])}
    taken = {j for i in chosen for j in range(i, i + 4)}
    i = 0
    while i + 4 <= len(groups):
        if not taken & set(range(i, i + 4)) and passes(groups[i : i + 4]):
            chosen.add(i)
            taken |= set(range(i, i + 4))
            i += 4
        else:
            i += 1
    text = " ".join(groups)
    row = pii.pseudonymize(spark.createDataFrame([(1, f"a run: {text}.")], "doc_id long, text string"), "k").first()
    new = row["text"].removeprefix("a run: ").removesuffix(".").split(" ")
    assert row["found_kinds"] == ["card"] * len(chosen)
    assert [g for j, g in enumerate(new) if j not in taken] == [g for j, g in enumerate(groups) if j not in taken]
    assert all(passes(new[i : i + 4]) for i in chosen)
    assert sum(new[i : i + 4] != groups[i : i + 4] for i in chosen) == len(chosen) > 100


# 8


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            s = b[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return out


def repeat_rows(n=250):
    random.seed(8)
    pool = ["".join(random.choice("ab cé") for _ in range(random.randint(40, 160))) for _ in range(30)]

    def part():
        p = random.choice(pool)
        a = random.randint(0, 60)
        return random.choice([p, p[a : a + random.randint(45, 70)], "".join(random.choice("abcdefgh \n") for _ in range(random.randint(0, 80)))])

    rows = [(i, "".join(part() for _ in range(random.randint(0, 6)))) for i in range(n)]
    rows += [(n + i, random.choice(rows)[1]) for i in range(20)]
    rows += [(500, "For " * 100), (501, "For " * 60 + "x" * 70), (502, "x" * 49), (503, "x" * 50), (504, None), (None, rows[3][1]), (505, ""), (7, rows[7][1]), (8, rows[9][1]), (600, "\0" * 60), (601, "a" + "\0" * 55)]
    random.shuffle(rows)
    return rows


def by_row(r):
    return tuple((x is not None, x) for x in r)


def test_repeats_equal_brute_force(spark):
    rows = repeat_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit("extra"))
    found = [tuple(r)[:5] for r in substrings.repeated_spans(df).collect()]
    assert sorted(found, key=by_row) == sorted(brute_repeats(rows), key=by_row)


def test_runs_in_pieces_equal_whole(monkeypatch):
    texts = [(t or "").encode() for _, t in repeat_rows(60)]
    ends = np.cumsum([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)

    def strings(found):
        return sorted((int(k), p + i) for k, p, c in zip(*found, strict=True) for i in range(c))

    whole = strings(substrings.runs(data, ends))
    monkeypatch.setattr(substrings, "PIECE", 333)
    assert strings(substrings.runs(data, ends)) == whole
    assert len(whole) == sum(max(0, len(x) - 49) for x in texts)


@pytest.mark.parametrize("strings", [8, 1 << 15])
def test_levels_find_strings_of_smaller_documents(monkeypatch, strings):
    monkeypatch.setattr(substrings, "STRINGS", strings)
    random.seed(10)
    texts = [bytes(random.choice(b"ab") for _ in range(random.randint(50, 56))) if i % 3 else b"ab" * 27 for i in range(300)]
    documents = np.sort(np.array([random.randrange(120) for _ in texts]))
    runs, places = substrings.known_strings(documents, np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
    first = {}
    for d, t in zip(documents.tolist(), texts, strict=True):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    expected = {(r, i) for r, (d, t) in enumerate(zip(documents.tolist(), texts, strict=True)) for i in range(len(t) - 49) if first[t[i : i + 50]] < d}
    assert set(zip(runs.tolist(), places.tolist(), strict=True)) == expected


def test_repeats_odd_rows(odd, none):
    assert substrings.repeated_spans(odd).count() == len(ODD)
    assert substrings.repeated_spans(none).count() == 0


# 9 and 10


def test_elias_fano():
    random.seed(11)
    for _ in range(100):
        n = random.randint(0, 700)
        v = np.sort(np.random.default_rng(n).integers(0, random.choice([1, 5, 1000, 10**9]), n))
        ef, size = tokens.EliasFano.unpack(memoryview(tokens.EliasFano.of(v).pack()))
        assert ef.all().tolist() == v.tolist()
        assert all(ef.select(i) == v[i] for i in random.sample(range(n), min(n, 25)))
        if n > 300 and v[-1] > 10**6:
            assert size < n * 8 / 2


def test_encoder_equals_the_library():
    e = Encoder()
    plain_ids = lambda t: e.tokenizer.encode(t, add_special_tokens=False).ids
    random.seed(12)
    texts = ["a  b", "a \n b", "a\n\n\nb  \n c", " x", "x ", "\t\ta b", "it's  we'll x", "a b\x1cc", "<|endoftext|> hi", "a\r\n\r\nb", "12 34\n 56  ", "é　 ñ x", "čaj, naïve.", "a,b,c!!! d"]
    texts += ["".join(random.choice(" \n\tab1'é č\x85s!,.*字") for _ in range(random.randint(1, 16))) for _ in range(4000)]
    for at in range(0, len(texts), 64):
        for t, ids in zip(texts[at : at + 64], e.encode(texts[at : at + 64]), strict=True):
            assert ids.tolist() == plain_ids(t), repr(t)


def test_token_files_round_trip(spark, odd, none):
    e = Encoder()
    found = sorted((tuple(r) for r in tokens.round_trip(odd, block_ids=50).collect()), key=lambda r: r[1])
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (d, start, n, crc), r in zip(found, rows, strict=True):
        ids = [*(e.tokenizer.encode(r[1], add_special_tokens=False).ids if r[1] else []), 0]
        assert (d, start, n, crc) == (r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.round_trip(none).count() == 0


def test_block_gives_single_documents():
    parts = [np.arange(n, dtype="<u2") for n in (1, 7, 300, 1, 2)]
    block = tokens.Block(tokens.pack_block([None, 3, 3, 9, 10**12], np.concatenate(parts), np.array([len(x) for x in parts]), 0))
    assert block.doc_ids() == [None, 3, 3, 9, 10**12]
    assert all(block.document(i).tolist() == p.tolist() for i, p in enumerate(parts))


@pytest.mark.parametrize("block", [3, 64, 1 << 17])
def test_token_counts(spark, odd, none, block):
    e = Encoder(special_as_text=True)
    found = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(odd, block_ids=block).collect())
    assert found == Counter((r[0], len(e.encode([r[1]])[0])) for r in ODD)
    assert token_counts.count_tokens(none).count() == 0


def test_token_counts_of_another_end_id(spark, odd):
    """The end id and the width that a file was written with are what its scan looks for."""
    e = Encoder(special_as_text=True)
    found = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(odd, end_id=50255).collect())
    assert found == Counter((r[0], len(e.encode([r[1]])[0])) for r in ODD)
    wide = [(0, 0, 4, 70000, bytearray(np.array([1, 70000, 66000, 2, 70000, 4464], "<u4").tobytes()))]
    blocks = spark.createDataFrame(wide, "file int, block int, width int, end_id long, ids binary")
    assert sorted(tuple(r)[2] for r in token_counts.scan(blocks).where("closed").collect()) == [1, 2]


def test_token_files_order_equal_ids_by_their_texts(spark):
    rows = [(7, f"text number {i}") for i in range(50)]
    found = [sorted(tuple(r) for r in tokens.round_trip(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(5)).collect()) for step in (1, -1)]
    assert found[0] == found[1] and len(found[0]) == 50


def test_encoder_forgets_and_cuts_long_texts(monkeypatch):
    from tessera.llm import encoder as module

    monkeypatch.setattr(module, "MEMO", 20)
    monkeypatch.setattr(module, "TEXTS", 64)
    e = Encoder()
    random.seed(13)
    texts = ["".join(random.choice("ab c\n.,'é１ ") for _ in range(random.randint(0, 200))) for _ in range(200)] + [None, "", "x" * 300]
    for at in range(0, len(texts), 50):
        for t, ids in zip(texts[at : at + 50], e.encode(texts[at : at + 50]), strict=True):
            assert ids.tolist() == (e.tokenizer.encode(t, add_special_tokens=False).ids if t else []), repr(t)


def test_scan_stitches_blocks_and_files(spark):
    ids = [5, 5, 9, 9, 7, 7, 7, 7, 7, 9, 1, 2]
    for size in (1, 2, 5, 12):
        rows = [(i // 2, i % 2, np.array(ids[x : x + size], "<u2").tobytes()) for i, x in enumerate(range(0, len(ids), size))]
        blocks = spark.createDataFrame([(f, b, bytearray(x)) for f, b, x in rows], "file int, block int, ids binary")
        found = sorted(tuple(r) for r in token_counts.scan(blocks, end_id=9, width=2).collect())
        assert found == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 5, True), (3, 10, 2, False)]


def test_results_are_json_free_of_nan(spark, folder):
    rows = queries.QUERIES["op1_toxicity"](spark, folder).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and json.dumps([r["score"] for r in rows], allow_nan=False)


@pytest.mark.parametrize("ends", [(-5, 2**63 - 1), (-(2**63), 9), (-(2**63), 2**63 - 1)])
def test_jaccard_ids_at_the_ends_of_64_bits(spark, ends):
    low, top = ends
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(top, a), (top, b), (1, a), (low, c), (low, b), (3, c)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["component_id"]) for r in found}
    # one id with two texts ties what each of them is linked with
    assert got == {(x, low) for x in (low, top, 1, 3)}


@pytest.mark.parametrize(
    "block",
    ['<h2 id="copyright">{}</h2>', '<h2 id="banner">{}</h2>', '<p id="notice">{}</p>', '<div class="widget">{}</div>', '<section id="menu"><p>{}</p></section>', '<p class="ad">{}</p>'],
)
def test_html_names_drop_no_part_of_an_article(block):
    said = "This part belongs to the article as well as all others do."
    page = f"<body><nav><a href='/'>home</a></nav><article><h1>Title</h1><p>{said}</p>{block.format(said)}<p>{said}</p></article></body>"
    assert html.extract(page) == "\n".join(["Title", said, said, said])


def test_html_ratio_decides_on_doubtful_blocks_of_an_article():
    said = "A long paragraph of the article that goes on for a while, with words and words. " * 4
    links = "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(6))
    page = f"<article><h1>T</h1><p>{said}</p><p>short</p><ul class='menu'>{links}</ul><div class='ad'>Buy it now</div><p>{said}</p></article>"
    assert html.extract(page).split("\n") == ["T", said.strip(), "short", said.strip()]


def test_html_comments_without_an_end_are_linear():
    page = "<article><p>kept</p><script>var a = '<!--';</script><p>also</p><!-- a -- b --><p>too</p>" + "<!-- x " * 300_000
    assert html.extract(page) == "kept\nalso\ntoo"
