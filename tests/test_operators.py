"""Operators against worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.operators import evaluation, frontier, graph, linktypes, schemas, scoring
from webloom.plans import modeling, traverse
from webloom.sources import models


@pytest.mark.parametrize(("marks", "picked"), [("11111", [0, 2, 4]), ("1" * 10, [0, 4, 9]), ("01111", [1, 2, 4]), ("00011", [3, 4]), ("11100", [0, 2]), ("101", [0, 2]), ("00000", [])])
def test_sampling(spark, marks, picked):
    rows = spark.createDataFrame([("p", k, m) for k, m in enumerate(marks)], "page string, pos int, ok string")
    assert sorted(r["pos"] for r in schemas.links_to_fetch(rows, ["page"], F.col("ok") == "1").collect()) == picked
    links = ["/x" if m == "1" else "javascript:" for m in marks]
    assert len(modeling.sample(links, "http://h", 3)) == len(picked)


def test_description_length(spark):
    links = spark.createDataFrame([("A", "p1", "a"), ("A", "p1", "b"), ("A", "p2", "a"), ("A", "p2", "b"), ("B", "p3", "a")], "class_id string, page string, xpath string")
    urls = spark.createDataFrame([("p1", 2), ("p2", 2), ("p3", 1)], "page string, n int")
    cost = {r["class_id"]: r["cost"] for r in scoring.class_costs(links, urls).collect()}
    assert cost["A"] == pytest.approx(8.449921, abs=1e-6)
    assert cost["B"] == pytest.approx(2.8, abs=1e-6)
    pairs = spark.createDataFrame([("A", "B")], "a string, b string")
    assert scoring.merge_deltas(links, urls, pairs).first()["delta"] == pytest.approx(-0.015968, abs=1e-6)


def test_jaccard_of_empty_sets(spark):
    row = spark.createDataFrame([(["a"], ["a", "b"], [])], "a array<string>, b array<string>, e array<string>").select(scoring.jaccard(F.col("a"), F.col("b")), scoring.jaccard(F.col("e"), F.col("e"))).first()
    assert list(row) == [0.5, None]


@pytest.mark.parametrize(
    ("n", "k", "size", "refinable", "finer", "fetches", "action"),
    [(3, 1, 5, True, False, 3, "list"), (3, 2, 5, True, False, 3, "refine_finer"), (3, 2, 5, False, True, 3, "list"), (3, 3, 5, True, False, 3, "refine_finer"), (3, 3, 5, False, True, 3, "fetch_all"), (3, 3, 3, False, True, 3, "menu"), (2, 1, 2, True, False, 3, "list"), (2, 2, 2, True, False, 3, "menu"), (1, 1, 1, True, False, 3, "refine_coarser"), (1, 1, 1, True, True, 3, "singleton"), (1, 1, 1, False, False, 3, "singleton"), (4, 4, 4, False, True, 4, "menu")],
)
def test_typing(spark, n, k, size, refinable, finer, fetches, action):
    row = spark.range(1).select(linktypes.collection_action(*[F.lit(x) for x in (n, k, size, refinable, finer, fetches, "menu")]))
    assert row.first()[0] == action


def test_mutable_menu(spark):
    rows = [("m", "x", d, p, k, h) for p, hs in (("r1", ["l1", "l2"]), ("r2", ["l4", "l5"])) for k, (d, h) in enumerate(zip(("A", "B"), hs, strict=True))]
    items = linktypes.menu_items(spark.createDataFrame(rows, "class_name string, xpath string, dest string, src_page string, pos int, href string"))
    assert linktypes.menu_types(items).first()["menu_type"] == "mutable"
    assert sorted(r["xpath"] for r in linktypes.menu_links(items, linktypes.menu_types(items)).collect()) == ["(x)[1]", "(x)[2]"]


def test_rendering(spark):
    row = spark.range(1).select(text.menu_item_xpath(F.lit("x"), F.lit("3")), text.menu_item_xpath(F.lit("x"), F.lit("/y"))).first()
    assert list(row) == ["(x)[3]", 'x[@href="/y"]']


def test_bfs_with_cycles(spark):
    edges = spark.createDataFrame([("m", "a", "b"), ("m", "b", "c"), ("m", "c", "a"), ("m", "b", "b"), ("m", "x", "y")], "model string, src string, dest string")
    roots = spark.createDataFrame([("m", "a")], "model string, name string")
    assert {r["name"]: r["depth"] for r in graph.bfs_depth(edges, roots).collect()} == {"a": 0, "b": 1, "c": 2}


def test_evaluation_of_a_perfect_and_a_merged_model(spark):
    golden = spark.createDataFrame([("A", "http://s/a.*"), ("B", "http://s/b.*")], "name string, pattern string")
    pages = [("1", f"http://s/a{k}") for k in range(3)] + [("2", f"http://s/b{k}") for k in range(2)]
    for merge, f, purity, entropy in ((False, 1.0, 1.0, 0.0), (True, (3 * 0.75 + 2 * 4 / 7) / 5, 0.6, -(0.6 * math.log(0.6) + 0.4 * math.log(0.4)))):
        df = spark.createDataFrame([("1" if merge else c, u) for c, u in pages], "class_id string, url string")
        sizes = df.groupBy("class_id").agg(F.count("*").alias("size"))
        matrix = evaluation.count_matrix(evaluation.golden_matches(df, golden), sizes, golden)
        best = evaluation.best_matches(evaluation.precision_recall(matrix, sizes))
        assert evaluation.weighted_f(best).first()[0] == pytest.approx(f)
        assert evaluation.weighted_mean(evaluation.purity(matrix, sizes), "purity").first()[0] == pytest.approx(purity)
        assert evaluation.weighted_mean(evaluation.cohesion(matrix, sizes), "entropy").first()[0] == pytest.approx(entropy)


def test_golden_patterns_beyond_a_broadcast(spark, monkeypatch):
    golden = spark.createDataFrame([("A", "http://s/a.*"), ("B", "http://s/b.*"), ("C", "http://s/.*"), ("D", "http://s/b1")], "name string, pattern string")
    pages = spark.createDataFrame([("1", f"http://s/a{k}") for k in range(3)] + [("2", f"http://s/b{k}") for k in range(2)], "class_id string, url string")
    want = sorted(map(tuple, evaluation.golden_matches(pages, golden).collect()))
    monkeypatch.setattr(evaluation, "PATTERNS", 2)
    monkeypatch.setattr(evaluation.small, "__defaults__", (2,))
    assert sorted(map(tuple, evaluation.golden_matches(pages, golden).collect())) == want and len(want) == 11


def test_link_recall_matches_one_to_one(spark):
    schema = "src string, link_type string, dest string"
    golden = spark.createDataFrame([("h", "list", "a"), ("h", "list", "a"), ("h", "menu", "b")], schema)
    computed = spark.createDataFrame([("h", "list", "a"), ("h", "menu", "b"), ("h", "menu", "b")], schema)
    assert evaluation.link_recall(golden, computed).first()["links_recall"] == pytest.approx(2 / 3)


def test_frontier_rules(spark):
    rows = spark.createDataFrame([("s", "http://h/", None, "c1", 0), ("s", "http://h", None, "c1", 0), ("s", "http://h/a?x", None, "c2", 1), ("s", "http://h/a#f", None, "c2", 1), ("s", "http://h/a", None, "c2", 1)], "site string, url string, form_params string, class_name string, depth int")
    seen = spark.createDataFrame([], "site string, key string")
    assert sorted(r["url"] for r in frontier.dedupe(rows, seen).collect()) == ["http://h", "http://h/a", "http://h/a?x"]
    assert [r["url"] for r in frontier.top_k(rows, 2).collect()] == ["http://h", "http://h/"]
    attempts = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), ("c", 0)], "url string, code int")
    assert {r["url"]: r["state"] for r in frontier.retries(attempts, 1).collect()} == {"a": "dropped", "b": "retry", "c": "done"}


def test_model_files(spark, tmp_path):
    lines = ["home\tlink\t//a\titems\tlist", "items\tstring\t//h1/text()\ttitle", "items\tlink\t//b\thome\tNext"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    target = models.read_target(spark, str(tmp_path / "t.csv"))
    assert [(r["src"], r["dest"], r["link_type"], r["anchor_text"]) for r in models.target_links(target).orderBy("ord").collect()] == [("home", "items", "list", None), ("items", "home", "singleton", "Next")]
    assert models.target_data(target).first()["field_name"] == "title"
    assert {r["name"]: r["is_root"] for r in models.target_classes(target).collect()} == {"home": True, "items": False}
    (tmp_path / "g.csv").write_text("A\tx.*,y\nB\tz\n\nA\tlist\tB\nA\tlist\tB\n")
    classes, links = models.read_golden(spark, str(tmp_path / "g.csv"))
    assert classes.count() == 3
    assert links.count() == 2


def page(site, path, html):
    return (site, site + path, None, site + path, 200, html)


SITE = "http://s.test"


def small_store(spark):
    nav = '<ul id="menu"><li><a href="/list1">l</a></li><li><a href="/about">a</a></li></ul>'
    rows = [page(SITE, "", f"<h1>Home</h1>{nav}<p class=x>welcome</p>")]
    rows += [page(SITE, f"/list{k}", f'<h1>List {k}</h1><div id="c">' + "".join(f'<p><a href="/item{k}{j}">i</a></p>' for j in range(4)) + "</div>" + ('<a class="n" href="/list2">next</a>' if k == 1 else "")) for k in (1, 2)]
    rows += [page(SITE, f"/item{k}{j}", f'<h1>Item {k}{j}</h1><span class="back"><b><a href="/list{k}">b</a></b></span>') for k in (1, 2) for j in range(4)]
    rows += [page(SITE, "/about", "<h2>About us</h2><div><i>text</i></div>")]
    return spark.createDataFrame(rows, "site string, url string, form_params string, final_url string, status int, html string")


def test_inferred_model(spark):
    rows = modeling.build_models(small_store(spark), 50).collect()
    classes = {}
    for r in rows:
        if r["row_kind"] == "page":
            classes.setdefault(r["class_name"], set()).add(r["url"].removeprefix(SITE))
    items = next(c for c in classes.values() if "/item10" in c)
    assert all(u.startswith("/item") for u in items)
    links = [(r["class_name"], r["link_type"]) for r in rows if r["row_kind"] == "link"]
    assert "list" in {t for _, t in links}
    home = next(k for k, c in classes.items() if "" in c)
    assert {r["depth"] for r in rows if r["class_name"] == home} == {0}


def test_loop_costs_agree_with_the_queries(spark):
    store = {u.removesuffix("/"): (f, h) for _, u, _, f, _, h in small_store(spark).collect()}
    m = modeling.Modeler(SITE, store, 50)
    m.run()
    rows = [(str(k), p.url, x) for k, ps in m.classes.items() for p in ps for x in p.paths()]
    named = [(str(k), p.url, x) for k, ps in m.classes.items() for p in ps for x in set(p.labels) & m.class_labels(ps)]
    idf = m.idf()
    links = spark.createDataFrame(rows, "class_id string, page string, xpath string")
    labels = spark.createDataFrame(named, "class_id string, page string, xpath string") if named else None
    urls = spark.createDataFrame([(p.url, p.n_urls(m.collections)) for ps in m.classes.values() for p in ps], "page string, n int")
    weights = spark.createDataFrame([(str(k), x, sum(x in p.paths() or (x in p.labels and x in m.class_labels(ps)) for p in ps) / len(ps) * idf[x]) for k, ps in m.classes.items() for x in {x for p in ps for x in p.paths()} | m.class_labels(ps)], "class_id string, xpath string, tfidf double")
    got = {r["class_id"]: r["cost"] for r in scoring.class_costs(links, urls, labels, weights).collect()}
    for k, ps in m.classes.items():
        if str(k) in got:
            assert got[str(k)] == pytest.approx(m.cost(ps, idf)), k


def test_guided_crawl_with_a_missing_page(spark):
    store = small_store(spark).filter("url <> 'http://s.test/item13'")
    seeds = spark.createDataFrame([(SITE, SITE, "home")], "site string, url string, class_name string")
    links = spark.createDataFrame([("home", "(//ul[@id='menu']/li/a)[1]", "list"), ("list", "//div[@id='c']/p/a", "item"), ("list", "//a[@class='n']", "list")], "src string, xpath string, dest string")
    data = spark.createDataFrame([("item", 0, "//h1/text()", "string")], "class_name string, ord int, xpath string, data_type string")
    depths = spark.createDataFrame([("home", 0), ("list", 1), ("item", 2)], "name string, depth int")
    crawl = traverse.crawl(store, seeds, links, data, depths, per_round=3)
    found = {r["url"].removeprefix(SITE): r["class_name"] for r in crawl.url_class.collect()}
    assert found == {"": "home", "/list1": "list", "/list2": "list"} | {f"/item{k}{j}": "item" for k in (1, 2) for j in range(4) if (k, j) != (1, 3)}
    assert sorted(r["record"][0] for r in crawl.records.collect())[0] == "Item 10"
    assert [r["url"] for r in crawl.failed.collect()] == [SITE + "/item13"]
    assert traverse.crawl(store, seeds, links, data, depths, budget=2).url_class.count() == 2


def test_evaluation_of_an_inferred_model(spark):
    from webloom.plans.evaluate import evaluate

    rows = modeling.build_models(small_store(spark), 50)
    pages = rows.filter("row_kind = 'page'").select(F.col("class_name").alias("class_id"), "url")
    links = rows.filter("row_kind = 'link'").select(F.col("class_name").alias("src"), "link_type", "dest")
    golden = spark.createDataFrame([("home", SITE), ("list", SITE + "/list.*"), ("item", SITE + "/item.*"), ("about", SITE + "/about")], "name string, pattern string")
    wanted = spark.createDataFrame([("list", "list", "item"), ("list", "menu", "nowhere")], "src string, link_type string, dest string")
    found = evaluate(pages, golden, wanted, links)
    row = found.summary.first()
    assert row["weighted_f"] > 0.7
    assert 0 < row["purity"] <= 1
    assert row["links_recall"] == pytest.approx(0.5)
    assert found.report.count() == 4


def test_depth_of_a_long_chain_and_a_limit(spark):
    edges = spark.createDataFrame([("m", f"c{k}", f"c{k + 1}") for k in range(105)] + [("m", "c9", "c2")], "model string, src string, dest string")
    roots = spark.createDataFrame([("m", "c0")], "model string, name string")
    assert {r["name"]: r["depth"] for r in graph.bfs_depth(edges, roots).collect()} == {f"c{k}": k for k in range(106)}
    with pytest.raises(RuntimeError, match="beyond 3 levels"):
        graph.bfs_depth(edges, roots, most=3)


def test_budgets_by_site_and_a_limit_of_rounds(spark):
    rows = []
    for site, n in (("http://a.test", 6), ("http://b.test", 4)):
        rows += [page(site, "", '<a href="/p0">first</a>'), *(page(site, f"/p{k}", f'<a href="/p{k + 1}">next</a>') for k in range(n))]
    store = spark.createDataFrame(rows, "site string, url string, form_params string, final_url string, status int, html string")
    seeds = spark.createDataFrame([("http://a.test", "http://a.test", "c", 3), ("http://b.test", "http://b.test", "c", None)], "site string, url string, class_name string, budget int")
    links = spark.createDataFrame([("c", "//a", "c")], "src string, xpath string, dest string")
    data = spark.createDataFrame([], "class_name string, ord int, xpath string, data_type string")
    depths = spark.createDataFrame([("c", 0)], "name string, depth int")
    found = traverse.crawl(store, seeds, links, data, depths, max_failures=0)
    assert sorted((r["site"], r["n"]) for r in found.url_class.groupBy("site").agg(F.count("*").alias("n")).collect()) == [("http://a.test", 3), ("http://b.test", 5)]
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        traverse.crawl(store, seeds, links, data, depths, most_rounds=2)


def test_forms_are_posted(spark):
    form = '<form id="f"><input name="q" value="x"><input name="n" value="1"></form>'
    rows = [page(SITE, "", f"<h1>Home</h1>{form}<a href='/asked'>a</a>"), page(SITE, "/asked", f"<h1>Ask</h1>{form}")]
    rows += [(SITE, SITE, "q=x;n=1;", SITE + "/result", 200, "<h1>Result</h1>"), (SITE, SITE + "/asked", "q=x;n=1;", SITE + "/other", 200, "<h1>Answer</h1>")]
    store = spark.createDataFrame(rows, "site string, url string, form_params string, final_url string, status int, html string")
    links = spark.createDataFrame([("home", "//form[@id]", "result", "form"), ("home", "//a", "asked", "list")], "src string, xpath string, dest string, link_type string")
    forms = spark.createDataFrame([("asked", "//form[@id]")], "class_name string, form string")
    data = spark.createDataFrame([(c, 0, "//h1/text()", "string") for c in ("home", "result", "asked")], "class_name string, ord int, xpath string, data_type string")
    depths = spark.createDataFrame([("home", 0), ("result", 1), ("asked", 1)], "name string, depth int")
    found = traverse.crawl(store, spark.createDataFrame([(SITE, SITE, "home")], "site string, url string, class_name string"), links, data, depths, forms=forms)
    # a posted address is known by what answers, a class's own form by the address of the form
    assert {(r["url"], r["record"][0]) for r in found.records.collect()} == {(SITE, "Home"), (SITE + "/result", "Result"), (SITE + "/asked", "Answer")}


def test_a_large_site_is_never_in_one_group(spark, monkeypatch):
    from webloom.sources import store as s

    rows = [page(SITE, "", "<ul>" + "".join(f'<li><a href="/p{k}">{k}</a></li>' for k in range(400)) + "</ul>")]
    rows += [page(SITE, f"/p{k}", f'<h1>Page {k}</h1><div><a href="/">home</a></div><p><a href="/p{(k * 7) % 400}">x</a></p>') for k in range(400)]
    held = []
    append = s.Grown.append
    monkeypatch.setattr(s.Grown, "append", lambda self, df: held.append(self) or append(self, df))
    store = spark.createDataFrame(rows, "site string, url string, form_params string, final_url string, status int, html string")
    got = sorted(map(str, modeling.build_models(store, 5).collect()))
    pages = next(g for g in held if "held-pages" in g.path).table()
    assert pages.count() <= 16
    m = modeling.Modeler(SITE, {u.removesuffix("/"): (f, h) for _, u, _, f, _, h in rows}, 5)
    m.run()
    m.finish()
    whole = spark.createDataFrame(m.rows(), modeling.MODEL_SCHEMA)
    assert sorted(map(str, whole.collect())) == got


ODD_PAGES = [
    '<a class="x" href="/a">1</a><a href="/b">2</a><A HREF=\'/c\'>3</A><a href=/d>4</a>',
    '<p><a href="/a?x=1&amp;y=2">1</a></p>', '<!-- <a href="/no">x</a> --><a href="/yes">y</a>', '<script>"<a href=\\"/no\\">"</script><a href="/yes">y</a>',
    '<div title=\'<a href="/no">\'><a href="/yes">y</a></div>', '<table><tr><td><a href="/cell">c</a></td></tr></table><a href="/after">a</a>', '<a href="/open', '<title><a href="/no"></title><a href="/yes">y</a>',
    '<style>a{}</style><nav><ul><li><a href="/1">1</a></li><li><a href="/2">2</a></li></ul></nav>', '<a name="top">t</a><a href="/x">x</a>', '<a href="/x" class="y">x</a><svg><a href="/svg"/></svg>', "", None, '<a\nhref="/line">l</a>', "<a href=\"/q\">&lt;a href=\"/no\"</a>",
]


def test_anchors_by_pattern_and_by_tree(spark, sf):
    from webloom.sources import pages as P

    rows = spark.createDataFrame([(k, "http://s.test/p", h) for k, h in enumerate(ODD_PAGES)], "page_id long, url string, html string").unionByName(P.read_pages(spark, sf).select("page_id", "url", "html").withColumn("page_id", F.col("page_id") + 1000))
    want = sorted(map(tuple, P.page_links(rows, "page_id", "url").select("page_id", "pos", "href").collect()))
    assert sorted(map(tuple, P.anchors(rows).select("page_id", "pos", "href").collect())) == want
    assert [h for i, _, h in want if i == 0] == ["/a", "/b", "/c", "/d"]
    plain = {r["page_id"] for r in rows.filter(P.is_plain(F.col("html"))).collect()}
    assert {i for i in plain if i < 1000} <= {2, 3, 8, 11, 14} and any(i >= 1000 for i in plain)


def test_saved_pages_and_records_come_back(spark, tmp_path):
    from webloom.sources import pages as P

    pages = spark.createDataFrame([(SITE, SITE, "<h1>é</h1>\nx"), (SITE, SITE + "/a/b?q=1&r=2", "<p>2</p>")], "site string, url string, html string")
    P.write_saved(pages, str(tmp_path / "mirror"))
    assert {(r["file"], r["html"]) for r in P.read_saved(spark, str(tmp_path / "mirror")).collect()} == {("html/s_test_mirror/index.html", "<h1>é</h1>\nx"), ("html/s_test_mirror/a/bq_1r_2.html", "<p>2</p>")}
    records = spark.createDataFrame([(SITE, "item", SITE + "/a", ["x", "y"])], "site string, class_name string, url string, record array<string>")
    models.write_records(models.record_rows(records).withColumn("site", F.lit(SITE)), str(tmp_path / "records"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "records")).collect()] == [f"{SITE}/a\tx\ty"]


def test_models_with_forms_and_data_come_back(spark, tmp_path):
    links = spark.createDataFrame([(0, "home", "//a", "items", "list"), (1, "items", "//b", "home", "Next")], "depth int, src string, xpath string, dest string, subtype string").withColumns({"menu_xpath": F.lit(""), "menu_type": F.lit("")})
    forms = spark.createDataFrame([(0, "home", "//form")], "depth int, class_name string, form string")
    data = spark.createDataFrame([(1, "items", 0, "string", "//h1/text()", "title"), (1, "items", 1, "url", "//a", None)], "depth int, class_name string, ord int, data_type string, xpath string, field_name string")
    models.write_lines(models.model_lines(links, forms, data), str(tmp_path / "m"), "depth", "src", "block", "ord", "xpath")
    back = models.read_target(spark, str(tmp_path / "m"))
    assert [(r["src"], r["dest"], r["link_type"]) for r in models.target_links(back).orderBy("ord").collect()] == [("home", "items", "list"), ("items", "home", "singleton")]
    assert [tuple(r) for r in models.target_forms(back).collect()] == [("home", "//form")]
    assert [(r["xpath"], r["data_type"], r["field_name"]) for r in models.target_data(back).orderBy("ord").collect()] == [("//h1/text()", "string", "title"), ("//a", "url", None)]


def test_deleting_a_version_takes_what_it_reaches(spark):
    versions = spark.createDataFrame([("s", 1, 10, "a"), ("s", 2, 20, "a")], "site string, version int, ts long, root_class string")
    links = spark.createDataFrame([("s", v, x, y) for v in (1, 2) for x, y in (("a", "b"), ("b", "c"), ("z", "a"))], "site string, version int, src string, dest string")
    data = spark.createDataFrame([("s", v, c, "//p") for v in (1, 2) for c in "cz"], "site string, version int, class_name string, xpath string")
    v, kept, values = models.delete_models(versions, links, data, 1)
    assert [r["version"] for r in v.collect()] == [2]
    assert sorted((r["version"], r["src"]) for r in kept.collect()) == [(1, "z"), (2, "a"), (2, "b"), (2, "z")]
    assert sorted((r["version"], r["class_name"]) for r in values.collect()) == [(1, "z"), (2, "c"), (2, "z")]


def test_close_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = []
    for g in range(12):
        own = [f"g{g}p{k}" for k in range(rng.randint(8, 20))]
        for c in range(4):
            rows += [(f"k{g}_{c}", e) for e in [*rng.sample(own, len(own) - rng.randint(0, 2)), "menu", "home"]]
    members = spark.createDataFrame(rows, "class_id string, xpath string")
    want = scoring.jaccard_pairs(members, "class_id", "xpath").filter("distance < 0.2")
    assert sorted(map(tuple, scoring.collapse_pairs(members, "class_id", "xpath").collect())) == sorted(map(tuple, want.collect())) != []


def test_a_whole_run_of_an_inferred_model(spark, tmp_path):
    from webloom.plans.run import run

    (tmp_path / "golden.csv").write_text(f"home\t{SITE}\nlist\t{SITE}/list.*\nitem\t{SITE}/item.*\n\nlist\tlist\titem\n")
    folder = str(tmp_path / "out")
    found = run(spark, [{"site": SITE, "model_pages": 50, "crawl": True, "save_pages": True, "golden": str(tmp_path / "golden.csv")}], small_store(spark), folder)
    urls = {r["url"] for r in found.url_class.collect()}
    assert {SITE, SITE + "/list1", SITE + "/about"} <= urls and sum("/item" in u for u in urls) >= 4
    assert spark.read.text(f"{folder}/index").count() == len(urls)
    assert models.read_targets(spark, f"{folder}/models").filter("kind = 'link'").count() > 2
    assert spark.read.text(f"{folder}/evaluations/s.test").count() == 3
    assert found.schedule.count() == len(urls) and found.versions.first()["version"] == 1


def test_places_of_one_address_do_not_depend_on_the_order_of_rows(spark):
    rows = [("h", "http://h/x", None, "c", 1, k) for k in range(50)]
    for given in (rows, rows[::-1]):
        pages = spark.createDataFrame(given, "site string, url string, form_params string, class_name string, depth int, page_id long").coalesce(1)
        spilled = frontier.spill(pages, 4, "page_id").collect()
        assert sorted((r["page_id"], r["nth"], r["in_memory"]) for r in spilled) == [(k, k + 1, k < 4) for k in range(50)]
        assert sorted(r["page_id"] for r in frontier.top_k_by_site(pages, 3, "page_id").collect()) == [0, 1, 2]


def test_pairs_of_keys_with_equal_sets(spark, monkeypatch):
    import random

    monkeypatch.setattr(scoring, "CHUNK", 7)  # several chunks a set
    monkeypatch.setattr(scoring, "PAIRS_A_TASK", 100)
    rng = random.Random(5)
    kinds = [set(rng.sample("abcdefghijkl", rng.randint(1, 9))) for _ in range(8)] + [set("abcdefg"), set("abcdef"), {"a", None}, {None}]
    sets = {k: kinds[k % 12] if k % 3 else kinds[rng.randint(0, 2)] for k in range(90)}
    members = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s for _ in range(2)] + [(None, "a")], "class_id long, xpath string")
    shared = {(a, b): len((sets[a] & sets[b]) - {None}) for a in sets for b in sets if a < b}
    want = {p: n for p, n in shared.items() if n and n == min(len(sets[p[0]]), len(sets[p[1]]))}
    got = [tuple(r) for r in scoring.subset_pairs(members, "class_id", "xpath").collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    union = {(a, b): len(sets[a]) + len(sets[b]) - n for (a, b), n in shared.items()}
    want = {p: (n, (union[p] - n) / union[p]) for p, n in shared.items() if n and (union[p] - n) / union[p] < 0.2}
    got = [tuple(r) for r in scoring.collapse_pairs(members, "class_id", "xpath").collect()]
    assert len(got) == len(want) and {(a, b): (n, d) for a, b, n, d in got} == want


def test_equal_sets_are_compared_once(spark):
    members = spark.createDataFrame([(k, e) for k in range(300) for e in "abcdef"[: 5 + k % 2]], "class_id long, xpath string")
    for of in (scoring.subset_pairs, scoring.collapse_pairs):
        plan = of(members, "class_id", "xpath")
        assert plan.count() == 300 * 299 // 2
        # pairs of keys come from chunks, in no join and no shuffle of their own
        assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString(), of


def test_links_of_a_page_do_not_carry_its_list(spark):
    xml = "<html><body>" + "".join(f'<ul><li><a href="/p{k}">x</a></li></ul>' for k in range(500)) + '<p><a href="http://o.test/">o</a><a href="/q">q</a></p></body></html>'
    pages = spark.createDataFrame([("http://h.test", "http://h.test/", "home", xml), ("http://h.test", "http://h.test/i", "item", xml), ("http://h.test", "http://h.test/n", "home", None)], "site string, url string, class_name string, xml string")
    links = [("home", "//li/a", "item"), ("home", "//p/a", "other"), ("item", "//p/a", "home"), ("item", "//b", "none")]
    rows = traverse.out_links(pages, links)
    got = sorted(tuple(r) for r in rows.select("page", "xpath", "pos", "link", "dest").collect())
    home = "http://h.test/"
    assert got == sorted([(home, "//li/a", k, f"http://h.test/p{k}", "item") for k in range(500)] + [(home, "//p/a", 1, "http://h.test/q", "other"), (home + "i", "//p/a", 1, "http://h.test/q", "home")])
    # from a page to its links in one step: a second one had the page's whole list in every row
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_a_mirror_has_the_saved_pages_in_few_files(spark, tmp_path):
    from webloom.sources import pages as P

    rows = [(f"http://s{k % 2}.test", f"http://s{k % 2}.test/a/{k}?q={k}", f"<h1>é{k}</h1>\n") for k in range(60)]
    pages = spark.createDataFrame([*rows, *rows[:5]], "site string, url string, html string")
    P.write_mirror(pages, str(tmp_path / "mirror"))
    P.write_saved(pages, str(tmp_path / "files"))
    got = sorted((r["site"], r["file"], r["html"].rstrip()) for r in P.read_mirror(spark, str(tmp_path / "mirror")).collect())
    assert got == sorted((r["site"], r["file"], r["html"].rstrip()) for r in P.read_saved(spark, str(tmp_path / "files")).collect()) and len(got) == 60
    assert len(list((tmp_path / "mirror").rglob("*.parquet"))) <= 8  # not one a page


def test_classes_with_one_path_share_a_column(spark):
    classes = [f"s{k}\nhome" for k in range(40)]
    pages = spark.createDataFrame([("http://h.test", f"http://h.test/{k}", c, f'<p><a href="/{k}">t{k}</a></p>') for k, c in enumerate(classes)], "site string, url string, class_name string, xml string")
    found = traverse.out_links(pages, [(c, "//p/a", f"d{k}") for k, c in enumerate(classes)])
    assert sorted((r["class_name"], r["link"], r["dest"]) for r in found.collect()) == sorted((c, f"http://h.test/{k}", f"d{k}") for k, c in enumerate(classes))
    made = traverse.records(pages, [(c, "string", "//p/a/text()") for c in classes])
    assert sorted((r["class_name"], r["record"][0]) for r in made.collect()) == sorted((c, f"t{k}") for k, c in enumerate(classes))
    forms = pages.withColumn("html", F.lit('<form id="f"><input name="q" value="1"></form>'))
    led = traverse.form_links(forms, [(c, "//form[@id]", f"d{k}") for k, c in enumerate(classes)])
    assert sorted((r["class_name"], r["dest"], r["form_params"]) for r in led.collect()) == sorted((c, f"d{k}", "q=1;") for k, c in enumerate(classes))
    for plan, what in ((found, "XPathListEvaluator"), (made, "XPathListEvaluator"), (led, "MapInArrow")):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count(what) < 8, what  # not one a class
