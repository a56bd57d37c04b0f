"""Vector searches, URL reputation, page extraction, and the pipeline."""

import tracemalloc

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import domtrees, ivfpq, kdtopk, queries, urlrep

from ..conftest import DATA

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


def vectors(spark, n=700, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in v], "x") for i, v in enumerate(np.round(rng.normal(size=(n, dim)), 2))]
    rows += [(n + k, rows[5][1], "copy") for k in range(300)] + [(5, rows[5][1], "x"), (None, rows[1][1], "x"), (3000, None, "x"), (3100, [1.0, None] * 4, "x"), (3200, [float("nan")] * 8, "x"), (3300, [], "x"), (3400, [0.0] * 8, "x"), (3500, [1.0, 2.0], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def test_top_k_is_brute_force(spark, duck):
    df = vectors(spark)
    table = df.toArrow()
    duck.register("embeddings", table)
    want = sorted(map(tuple, duck.sql(queries.ORACLES["op1_kdtopk"]).fetchall()))
    assert sorted(map(tuple, kdtopk.top_k(df, shard_rows=200, block_rows=4).collect())) == want and want
    assert sorted(map(tuple, kdtopk.top_k(df, shard_rows=20, block_rows=3).collect())) == want


def test_products_beyond_a_long_are_held_at_its_ends(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 1.0]), (3, [1.0, 1.0]), (4, [1.7e308, -1.7e308]), (100, [2.0**40, 3.0]), (5, [2.0**20, 1.0])] + [(k, [float(k), 1.0]) for k in range(10, 40)]
    got = [tuple(r) for r in kdtopk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=8, block_rows=1).collect()]
    e = {i: [int(np.nan_to_num(np.floor(1024.0 * x))) if abs(x) < 1e305 else int(np.nan_to_num(1024.0 * x)) for x in v] for i, v in rows}
    held = lambda n: min(max(n, -(2**63)), 2**63 - 1)
    want = []
    for q in (0, 100):
        found = sorted((-held(sum(a * b for a, b in zip(e[q], v, strict=True))), i) for i, v in e.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(got) == sorted(want) and max(r[3] for r in got) == 2**63 - 1


def test_shards_out_of_reach_are_skipped(spark, duck):
    """Clusters far apart: a query's block goes to few shards, with the same answers; products beyond 2**53 stay exact."""
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(16, 4)) * 40
    rows = [(int(i), [float(x) for x in np.round(centres[i % 16] + rng.normal(size=4), 2)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    duck.register("embeddings", df.toArrow())
    want = sorted(map(tuple, duck.sql(queries.ORACLES["op1_kdtopk"]).fetchall()))
    assert sorted(map(tuple, kdtopk.top_k(df, shard_rows=50, block_rows=8).collect())) == want
    sent, all_ = kdtopk.visits(df, shard_rows=50, block_rows=8)
    assert 0 < sent < all_ / 2
    big = [(int(i), [float(x) for x in rng.integers(-(1 << 18), 1 << 18, 4)]) for i in range(300)]
    ints = {i: [int(1024 * x) for x in e] for i, e in big}
    got = kdtopk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), shard_rows=50).where("query_id = 100").collect()
    dots = sorted(((-sum(a * b for a, b in zip(ints[100], e, strict=True)), i) for i, e in ints.items() if i != 100))[:10]
    assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(-s, i) for s, i in dots] and max(abs(s) for s, _ in dots) > 2**53


def test_trees_bound_their_products():
    rng = np.random.default_rng(3)
    x, q = np.floor(rng.normal(size=(500, 6)) * 1024), np.floor(rng.normal(size=(9, 6)) * 1024)
    tree = kdtopk.Tree(x)
    bounds = tree.bounds(q)
    for node, (a, b) in enumerate(tree.span):
        assert (bounds[:, node] + 1e-6 >= (q @ x[tree.order[a:b]].T).max(axis=1)).all()


def test_neighbours_recall_and_scores(spark):
    df = vectors(spark, 2000, 16, 4).where("vec_id < 2000 or vec_id is null")
    data = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect() if r["vec_id"] is not None}
    got, hit, n = ivfpq.neighbours(df).collect(), 0, 0
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    for q in (i for i in data if i % 50 == 0):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        best = sorted(data, key=lambda i: (-cos(data[q], data[i]) if i != q else 9, i))[:5]
        hit += len(set(best) & {r["vec_id"] for r in own})
        n += 5
        assert len(own) == 5 and all(abs(r["score"] - cos(data[q], data[r["vec_id"]])) < 1e-9 for r in own)
    assert hit / n >= 0.9


def test_neighbours_of_copies_go_by_id(spark):
    got = [r for r in ivfpq.neighbours(vectors(spark, 700)).collect() if r["query_id"] == 700]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [5, 701, 702, 703, 704]


def test_neighbours_of_every_length(spark):
    """Lengths with a model and lengths that are compared exactly: each query meets all rows of its own length."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(0, 600)] + [(1000 + i, [float(x) for x in rng.normal(size=2)]) for i in range(0, 31)] + [(2000 + i, [float(x) for x in rng.normal(size=5)]) for i in range(0, 400)]
    data = {i: np.array(e) for i, e in rows}
    got: dict = {}
    for r in ivfpq.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    asked = [i for i in data if i % 50 == 0]
    assert sorted(got) == asked
    hit = 0
    for q in asked:
        cos = {i: float(data[q] @ x / np.sqrt((x @ x) * (data[q] @ data[q]))) for i, x in data.items() if i != q and len(x) == len(data[q])}
        own = [i for _, i in sorted(got[q])]
        want = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        hit += len(set(own) & set(want))
        assert len(own) == 5 and own == sorted(own, key=lambda i: (-cos[i], i)) and (len(data[q]) != 2 or own == want)
    assert hit / (5 * len(asked)) >= 0.9


def test_approximate_stage_finds_the_neighbours(spark):
    """Recall of the codes alone, before the exact scores, with lists larger than what is reranked; and of the whole search."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 32))
    rows = spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    data = {i: r for i, r in enumerate(x)}
    u = ivfpq.unit(x)
    m = ivfpq.Model(x, 12)
    at = m.lists(u)
    codes, asked = m.codes(u, at), np.arange(0, 9000, 300)
    out = ivfpq.approximate(m, at, codes, np.arange(9000), u[asked], asked, m.probes(u[asked], np.bincount(at, minlength=len(m.centroids)), 128), 128)
    score = u[asked] @ u.T
    score[np.arange(len(asked)), asked] = -9
    true = np.argsort(-score, axis=1)[:, :5]
    assert np.mean([len(set(t) & set(f)) / 5 for t, f in zip(true, out[1], strict=True)]) >= 0.9
    assert np.bincount(at).min() > 128
    got: dict = {}
    for r in ivfpq.neighbours(rows, every=300, part_rows=700).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(set(t) & got[q]) / 5 for t, q in zip(true.tolist(), asked.tolist(), strict=True)]) >= 0.9 and len(data) == 9000


def found_of_true(spark, x):
    """The share of the 5 truly nearest rows that the search finds; its scores must be those of its rows."""
    rows = spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = ivfpq.unit(x)
    asked = np.arange(0, len(x), 50)
    score = u[asked] @ u.T
    score[np.arange(len(asked)), asked] = -9
    true = np.argsort(-score, axis=1)[:, :5]
    got: dict = {}
    for r in ivfpq.neighbours(rows).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - u[r["query_id"]] @ u[r["vec_id"]]) < 1e-12
    assert all(len(got[q]) == 5 for q in asked.tolist())
    return np.mean([len(set(t) & set(got[q])) / 5 for t, q in zip(true.tolist(), asked.tolist(), strict=True)])


@pytest.mark.parametrize("kind", ["tight", "tighter", "wide", "blob", "queries"])
def test_neighbours_recall_on_other_rows(spark, kind, monkeypatch):
    """Tight groups, many dimensions, one dense group in noise, and queries unlike most rows: codes alone tell little of whose neighbours are nearest."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(6000, 192 if kind == "wide" else 24))
    centres = rng.normal(size=(8, x.shape[1]))
    if kind in ("tight", "tighter"):
        x = centres[rng.integers(0, 8, len(x))] + x * (0.05 if kind == "tight" else 0.001)
    elif kind == "blob":
        x[np.arange(len(x)) % 50 < 10] = centres[0] + x[np.arange(len(x)) % 50 < 10] * 0.02
    elif kind == "queries":
        own = (np.arange(len(x)) % 50 == 0) | (np.arange(len(x)) % 7 == 0)
        x[own] = centres[rng.integers(0, 8, own.sum())] + 0.1 * x[own]
    assert found_of_true(spark, x) >= 0.93
    monkeypatch.setattr(ivfpq, "SAMPLE_VALUES", 1500 * x.shape[1])  # fitted on a quarter of the rows
    assert found_of_true(spark, x) >= 0.93


def test_fit_of_many_lists_takes_bounded_memory():
    """Products of the sample with all centroids at once took 2 GB of the driver here."""
    x = np.random.default_rng(8).standard_normal((1 << 16, 8))
    tracemalloc.start()
    try:
        m = ivfpq.Model(x, 2000)
        m.lists(ivfpq.unit(x))
        assert tracemalloc.get_traced_memory()[1] < 1e8
    finally:
        tracemalloc.stop()
    assert len(m.centroids) == 2000


def test_passes_over_a_part_are_brute_force():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:760] = x[700]  # copies
    u = ivfpq.unit(x)
    m = ivfpq.Model(x, 12)
    at = m.lists(u)
    order = np.lexsort((np.arange(1500), at))
    part = ivfpq.Part({"ids": order.tobytes(), "lists": at[order].astype(np.int32).tobytes(), "codes": m.codes(u[order], at[order]).tobytes(), "vectors": x[order].tobytes(), "dim": 16}, m)
    own = np.concatenate((np.arange(690, 710), np.arange(0, 400, 7)))
    asked, sizes = ivfpq.Asked(own, x[own]), np.bincount(at, minlength=len(m.centroids))
    near = np.round(u[own] @ u.T, 12)
    near[np.arange(len(own)), own] = -np.inf
    true = {(i, j) for i in range(len(own)) for j in np.lexsort((np.arange(1500), -near[i]))[:5].tolist()}

    def best(*found):
        of, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
        top = ivfpq.leading(of, ids, score, 5)
        return set(zip(of[top].tolist(), ids[top].tolist(), strict=True)), {int(i): float(score[top][of[top] == i].min()) for i in np.unique(of)}

    reach = m.reach(asked.u, sizes, len(m.centroids), 128)
    assert best(*ivfpq.early(m, part, asked, reach, 1500, 5))[0] == true  # every row is scored
    some, kth = best(*ivfpq.early(m, part, asked, m.reach(asked.u, sizes, 1, 128), 128, 5))
    assert len(some & true) < len(true)
    found = list(ivfpq.late(m, part, asked, reach, np.array([kth[i] for i in range(len(own))]), 5))  # any margin, until one is measured
    assert best(*found)[0] == true
    m.margin = 0.1
    few = list(ivfpq.late(m, part, asked, reach, np.array([kth[i] for i in range(len(own))]), 5))
    assert sum(len(f[0]) for f in few) <= sum(len(f[0]) for f in found) and len(best(*few)[0] & true) > 0.9 * len(true)


def test_chunks_of_queries_give_the_same(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((4000, 12)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(ivfpq.neighbours(rows, every=10).collect())
    monkeypatch.setattr(ivfpq, "CHUNK_VALUES", 150 * 12)  # some queries at once, of 400
    assert sorted(ivfpq.neighbours(rows, every=10).collect()) == whole and len(whole) == 400 * 5


def test_cosines_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(300, 4))
    size = np.array([1.0, 1e200, 1e-200])[np.arange(300) % 3]
    rows = spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in enumerate(x * size[:, None])], "vec_id long, embedding array<double>")
    u = ivfpq.unit(x)
    for r in ivfpq.neighbours(rows).collect():
        order = np.argsort(-(u @ u[r["query_id"]]))
        assert order[order != r["query_id"]][r["rank"] - 1] == r["vec_id"] and abs(r["score"] - u[r["query_id"]] @ u[r["vec_id"]]) < 1e-12


def test_vector_searches_on_odd_tables(spark):
    none = vectors(spark).where("false")
    assert kdtopk.top_k(none).count() == ivfpq.neighbours(none).count() == 0
    few = vectors(spark).where("vec_id in (0, 1, 2)")
    assert kdtopk.top_k(few).count() == ivfpq.neighbours(few).count() == 2


PAGES = [
    (0, "http://Shop.Example.COM/en/7?x", "h"), (1, "https://a.example.com/en/8", "h"), (2, "https://b.net/de/1", "h"), (3, "https://x.example.net/de/8#a", "h"), (4, "ftp://c.org/es/", "h"), (5, "http://notcom/en/", "h"),
    (6, None, None), (7, "no scheme", "h"), (None, "http://a.example.com/fr/", "h"), (8, "http://a.example.com/fr/", "h"), (8, "http://a.example.com/fr/", "h"), (9, "http://x.com:80/en/1", "h"), (10, "http://", "h"), (11, "http://b.net/fr/://q", "h"), (12, "http://İ.com/en/", "h"),
]


def test_url_rules(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in urlrep.judge(spark.createDataFrame(PAGES, "page_id long, url string, host string")).collect()}
    assert got[0] == ("shop.example.com", "/en/7", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2:] == ("net/de/", "allow")
    assert got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block") and got[5][2] is None and got[6][:2] == ("", "") and got[9][2] is None
    assert len(got) == 14


def test_url_reputation_is_its_sql(spark, duck):
    df = spark.createDataFrame(PAGES * 3 + [(100 + k, f"http://h{k % 7}.s{k % 3}.com/{'en' if k % 4 else 'fr'}/{k}", "h") for k in range(200)], "page_id long, url string, host string")
    duck.register("pages", df.toArrow())
    rel = duck.sql(queries.ORACLES["op2_urlrep"])
    assert sorted(map(str, map(tuple, urlrep.judge(df).collect()))) == sorted(map(str, rel.fetchall()))
    assert urlrep.judge(df.where("false")).count() == 0


def test_every_page_has_one_verdict(spark):
    """Hosts in brackets, empty, dotted, with ports: no row is lost or doubled, and one judgement goes by SQL too."""
    hosts = ["[a.b]", "q.[a.b]", "[a.b]:80", "", ".", "..", "a..b", "b]", "x.b]", "1.2.3.4", "5.1.2.3.4", "co.uk", ".co.uk", "a.co.uk.", "[::1]", "address", "x.address", ":80", "é.com"]
    pages = spark.createDataFrame([(k, f"http://{h}/{p}/{k}") for k, (h, p) in enumerate((h, p) for h in hosts for p in ("x", "en", "de"))] + [(900, None), (901, "none"), (None, "http://[a.b]/x")], "page_id long, url string")
    got = urlrep.judge(pages).collect()
    assert len(got) == 3 * len(hosts) + 3 and len({r["page_id"] for r in got}) == len(got)
    db = duckdb.connect()
    db.register("pages", pages.toArrow())
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, db.sql(queries.ORACLES["op2_urlrep"]).fetchall()))


def test_owners_of_hosts(spark):
    hosts = {"a.b.co.uk:80": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com": ("example.com", "com"), "com": ("com", "com"), "10.1.2.3:8080": ("10.1.2.3", "address"), "[::1]": ("[::1]", "address"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", *urlrep.owner(df["host"])).collect()} == hosts
    pages = [(k, f"http://{h}/fr/{k}") for k, h in enumerate(hosts)] + [(100 + k, f"http://h{k % 9}.{'co.uk' if k % 2 else '10.1.2'}.{k % 3}/{'en' if k % 4 else 'fr'}/") for k in range(60)]
    duck = duckdb.connect()
    pages = spark.createDataFrame(pages, "page_id long, url string")
    duck.register("pages", pages.toArrow())
    assert sorted(map(str, map(tuple, urlrep.judge(pages).collect()))) == sorted(map(str, duck.sql(queries.ORACLES["op2_urlrep"]).fetchall()))


def test_extraction_on_invented_pages():
    rng, trees, right = np.random.default_rng(123), domtrees.model(), 0
    for _ in range(60):
        source, blocks = domtrees.invent(rng)
        right += domtrees.main_texts(trees, [source]) == ["\n".join(blocks)]
    assert right >= 55


def test_extraction_of_odd_pages(spark):
    long = "<article>" + "<p>Some words, and more of them.</p>" * 3000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p", "x"), (4, "u", f"<html><body>{long}", "x"), (4, "u", f"<html><body>{long}", "x"), (None, "u", "<script>var a", "x"), (5, "u", "<nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>One&nbsp;two,\n three. <b>Four</b> five.<p>Six seven, eight.</article><footer>&copy; x</footer>", "x")]
    got = {r["page_id"]: r for r in domtrees.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == got[2]["text"] == got[3]["text"] == "" and got[4]["text"].count("\n") == 2999
    assert got[5]["text"] == "T & U\nOne two, three. Four five.\nSix seven, eight." and got[5]["n_chars"] == len(got[5]["text"])


T1="The ferry returned to the harbour on Monday, after eleven months of repairs that had been planned for three."
T2="Passengers queued from six in the morning; some had brought breakfast, and a brass band played on the pier."
T3="The operator said the new engines use a third less fuel. It did not say what the repairs had cost."
T4="A second ship will follow in autumn, if the yard keeps to its schedule this time."
LAYOUTS = [  # pages written by hand, and their main blocks
    # a news site: landmarks
    (f"<html><body><header><a href='/'>The Daily Pier</a></header><nav><ul><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li><li><a href='/w'>Weather</a></li></ul></nav><main><article><h1>Ferry is back</h1><p>{T1}</p><p>{T2}</p><h2>Less fuel</h2><p>{T3}</p></article></main><aside><h3>Most read</h3><ul><li><a href='/1'>Storm warning for the weekend</a></li><li><a href='/2'>Council votes on parking</a></li></ul></aside><footer><p>&copy; 2024 The Daily Pier. All rights reserved.</p></footer></body></html>",
     ["Ferry is back", T1, T2, "Less fuel", T3]),
    # a blog of nested divs, with comments
    (f"<body><div id='page'><div class='site-header'><h2><a href='/'>Notes from the coast</a></h2></div><div class='menu'><a href='/a'>About</a> <a href='/c'>Contact</a></div><div id='content'><div class='post'><h1>Ferry is back</h1><div class='entry-content'><p>{T1}</p><p>{T2}</p><p>{T3}</p></div></div><div id='comments'><h3>2 comments</h3><div class='comment'><b>Ada</b><p>I was there too, and the band was out of tune the whole morning, to be honest.</p></div><div class='comment'><b>Ben</b><p>Three months turned into eleven. Nobody is surprised, are they?</p></div></div></div><div class='sidebar'><h3>Archive</h3><ul><li><a href='/m'>May</a></li><li><a href='/j'>June</a></li></ul></div><div id='footer'>Powered by a small engine. Privacy. Imprint.</div></div></body>",
     ["Ferry is back", T1, T2, T3]),
    # a cookie notice and a newsletter form around a section, unclosed paragraphs
    (f"<body><div class='cookie-banner'><p>We use cookies to improve your visit. By going on you agree to our terms of use.</p><button>Accept</button></div><section class='article-body'><h1>Ferry is back</h1><p>{T1}<p>{T2}<blockquote><p>{T3}</p></blockquote><p>{T4}</section><form class='newsletter'><p>Get our stories by mail every week.</p><label>Mail</label><input name='m'><button>Join</button></form><div class='footer'><a href='/l'>Legal</a> <a href='/p'>Privacy</a></div>",
     ["Ferry is back", T1, T2, T3, T4]),
    # adverts inside the article
    (f"<body><nav class='topbar'><a href='/'>Home</a><a href='/x'>Shop</a></nav><article class='story'><h1>Ferry is back</h1><p>{T1}</p><div class='ad-slot'><p>Half price deck chairs, only this week at our store. Order now!</p></div><p>{T2}</p><aside class='promo'>Win a cruise for two: enter our competition today.</aside><p>{T3}</p></article><footer>Contact us at the pier office.</footer>",
     ["Ferry is back", T1, T2, T3]),
    # lists and a table of figures in the text
    (f"<body><div class='navigation'><ul><li><a href='/'>Start</a></li><li><a href='/b'>Timetable</a></li></ul></div><div class='main'><h1>Ferry is back</h1><p>{T1}</p><ul><li>New engines, built in the yard at Kiel.</li><li>Room for forty more bicycles on the lower deck.</li></ul><p>{T3}</p></div><div class='related'><h4>Related</h4><ul><li><a href='/1'>Old ferry sold</a></li></ul></div>",
     ["Ferry is back", T1, "New engines, built in the yard at Kiel.", "Room for forty more bicycles on the lower deck.", T3]),
    # hardly any markup
    (f"<h1>Ferry is back</h1><p>{T1}</p><p>{T2}</p><p>{T3}</p>", ["Ferry is back", T1, T2, T3]),
    # tags that draw, some never closed, and formulas
    (f"<body><nav><button>Menu</nav><article><h1>Ferry is back</h1><svg viewBox='0 0 1 1'><text>logo</text></svg><p>{T1}</p><video src='a.mp4'>No video here.</video><p>{T2}</p><p>Use fell: <math><mi>f</mi><mo>=</mo><mn>0.67</mn></math> of before.</p><canvas><p>{T3}</p></article><footer>&copy; Pier</footer>",
     ["Ferry is back", T1, T2, "Use fell: f=0.67 of before.", T3]),
    # an old page of tables
    (f"<body><table><tr><td class='menu'><a href='/'>Home</a><br><a href='/t'>Times</a><br><a href='/f'>Fares</a></td><td class='content'><h1>Ferry is back</h1><p>{T1}</p><p>{T2}</p><p>{T3}</p></td></tr><tr><td class='footer'>Last changed in May. Webmaster.</td></tr></table>",
     ["Ferry is back", T1, T2, T3]),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_extraction_of_pages_written_by_hand(k):
    source, want = LAYOUTS[k]
    assert domtrees.main_texts(domtrees.model(), [source])[0].split("\n") == want


@pytest.mark.parametrize("head", ["<body><button>Menu", "<body><object data='x'>", "<body><svg>", "<body><video src='x'>", "<body><map name='m'>", "<body><select><option>a", "<body><noscript><canvas><audio>"])
def test_unclosed_elements_swallow_nothing(head):
    text = domtrees.main_texts(domtrees.model(), [f"{head}<article><h1>Ferry is back</h1><p>{T1}</p><p>{T2}</p><p>{T3}</p></article>"])[0]
    assert all(t in text for t in (T1, T2, T3))
    assert domtrees.main_texts(domtrees.model(), [f"<article><p>{T1}</p><p>{T2}</p></article><script>var a = '<p>{T3}</p>'"])[0] == f"{T1}\n{T2}"


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    page = domtrees.Page("<li><ul>" + "<div>" * 60_000 + "<li>a</li><p>b" * 6000)
    assert len(page.tag) > 70_000 and time.perf_counter() - began < 10
    assert "b" in domtrees.main_texts(domtrees.model(), ["<div>" * 20_000 + f"<p>{T1}</p><p>{T2}</p>"])[0]


def test_decoding_is_consistent():
    page = domtrees.Page("<div><p>a b c</p><p>d e f</p></div><div><p>g</p></div>")
    rng = np.random.default_rng(5)
    for _ in range(50):
        kept = domtrees.decode(page, rng.random(len(page.tag)))
        assert all(page.text[i] is not None for i in kept)


def test_pipeline_stages(spark):
    frame, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    before = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(SF))
        assert frame.columns == before
        seen.append((name, frame.count()))
    packed = corpus_pipeline.run(spark, str(SF))
    ids = {r[0] for r in packed.select("doc_id").distinct().collect()}
    assert len(ids) == seen[-1][1] <= seen[0][1] <= 200 and len(corpus_pipeline.STAGES) == 4
