"""URLs, text, paths and trees against worked examples."""

import xml.etree.ElementTree as ET
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import dom, text, urls, xpathalg

SHOP = '<html><head><title>Shop</title></head><body><header><nav><ol id="top"><li><a href="/tools.html">Tools</a></li><li><a href="/team.html">Team</a></li></ol></nav></header><footer><span id="maker"><a href="http://maker.example">made by</a></span></footer></body></html>'
SHELF = '<html><body><main><section><div id="goods"><ol><li><a href="/saw">saw</a></li><li><a href="/axe">axe</a></li><li><a href="/shelf2" id="more">more</a></li></ol></div></section></main></body></html>'


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("url", "key"),
    [("http://h", ""), ("http://h/", ""), ("http://h/?p=1", ""), ("http://h/a?b=1&c", "/ab=1&c"), ("http://h/a#f", "/a")],
)
def test_relative_key(spark, url, key):
    assert column(spark, url, urls.relative_key) == key


def test_relative_key_with_form(spark):
    assert column(spark, "http://h/a", lambda c: urls.relative_key(c, F.lit("k=v;"))) == "/a>k=v;"


@pytest.mark.parametrize(("url", "name"), [("http://www.a.com/x(1)?q=2", "a_com_x_1__q=2"), ("http://localhost:8081", "localhost:8081")])
def test_normalize(spark, url, name):
    assert column(spark, url, urls.normalize_url) == name


def test_absolute_agrees_with_urljoin(spark):
    bases = ["http://h.test", "http://h.test/", "http://h.test/a/b.html", "http://h.test/a/b/?q=1#f", "https://h.test:81/x?y"]
    hrefs = ["/x", "x.html", "../x", "./y/", "?p=2", "//o.test/z", "http://o.test/a/", "a/../b", "../../../x", "/a/./b/../c", "x?y=/.."]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for b, h, got in rows.select("b", "h", urls.absolute_url(F.col("b"), F.col("h"))).collect():
        # a query alone belongs to the base's folder
        assert got == urljoin(b if b.count("/") > 2 else b + "/", "./" + h if h.startswith("?") else h).removesuffix("/"), (b, h)


@pytest.mark.parametrize(
    ("href", "ok"),
    [("/x", True), ("", True), ("http://h.test/x", True), ("http://www.h.test/x", False), ("//h.test/y", True), ("//o.test/y", False), ("javascript:f()", False), ("/a#b", False), ("mailto:a@b.c", False), ("/p.jpg", False), ("/crawler", False), (None, False)],
)
def test_valid(spark, href, ok):
    assert column(spark, href, lambda c: urls.is_valid_url(F.lit("http://h.test/p"), c)) is ok


def test_form_parts(spark):
    row = spark.createDataFrame([("http://h/a>k=v;odd;x=y;a=b=c;",)], "u string").select(urls.form_url(F.col("u")).alias("f")).select("f.address", urls.form_params(F.col("f.params")).alias("p")).first()
    assert row["address"] == "http://h/a"
    assert [(x["k"], x["v"]) for x in row["p"]] == [("k", "v"), ("x", "y")]


@pytest.mark.parametrize(("value", "out"), [(None, ""), ("a  b\n c", "a b c"), ('say "x", y', '"say ""x"", y"'), (" x ", "x")])
def test_format_csv(spark, value, out):
    assert column(spark, value, text.format_csv) == out


def test_extractors(spark):
    xml = dom.to_xml(dom.parse('<h2>Nuts &amp; bolts</h2><img src="/shop/2024/saw.jpg"><p id=maker><a href="http://maker.example">x</a></p>'))
    made = [text.extract("string", F.col("v"), "//h2/text()"), text.extract("img", F.col("v"), "//img"), text.extract("url", F.col("v"), "//p[@id='maker']/a"), text.extract("string", F.col("v"), "//h3/text()")]
    row = spark.createDataFrame([(xml,)], "v string").select(*[c.alias(f"c{k}") for k, c in enumerate(made)]).first()
    assert list(row) == ["Nuts & bolts", "saw.jpg", "http://maker.example", ""]
    assert text.extract("other", F.col("v"), "//x") is None


def test_default_paths():
    found = {h: xpathalg.render(p) for h, _, p in dom.links(dom.parse(SHOP))}
    assert found["/tools.html"] == "/html/body/header/nav/ol[@id]/li/a"
    found = {h: xpathalg.render(p) for h, _, p in dom.links(dom.parse(SHELF))}
    # no path has more than one attribute, that of the nearest element
    assert found["/saw"] == "/html/body/main/section/div[@id]/ol/li/a"
    assert found["/shelf2"] == "/html/body/main/section/div/ol/li/a[@id]"
    # the path of the goods matches the link to more of them too
    assert [n.get("href") for n in dom.select_text(dom.parse(SHELF), found["/saw"])] == ["/saw", "/axe", "/shelf2"]


def test_ladder():
    path = dom.links(dom.parse('<div class="x"><font><a href="/y">z</a></font></div>'))[0][2]
    assert xpathalg.render(path) == "/html/body/div[@class]/font/a"
    coarser = [xpathalg.render(p) for p in xpathalg.ladder(path, False)]
    assert coarser == ["//body/div[@class]/font/a", "//div[@class]/font/a", "//div/font/a", "//font/a", "//a"]
    assert [xpathalg.render(p) for p in xpathalg.ladder(path, True)] == ['/html/body/div[@class="x"]/font/a']
    assert xpathalg.render(xpathalg.coarsest(path)) == "//a"
    assert xpathalg.render(xpathalg.finest(path)) == '/html/body/div[@class="x"]/font/a'
    assert xpathalg.finer(xpathalg.coarsest(path)) is not None


@given(st.text(alphabet="<>/abp \"'=&;!-tdrul", max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_text_gives_well_formed_xml(html):
    ET.fromstring(dom.to_xml(dom.parse(html)))


@pytest.mark.parametrize("html", [None, "", "just text", "<p>a<p>b", "<table><tr><td>1<td>2<tr><td>3</table>", "<ul><li>a<li>b</ul><b>x"])
def test_trees(html):
    root = dom.parse(html)
    assert [c.name for c in root.children] == ["head", "body"]


def test_implied_ends():
    root = dom.parse("<table><tr><td>1<td>2<tr><td>3</table><p>a<p>b<div>c</div>")
    paths = [xpathalg.render(p) for _, p in dom.short_texts(root)]
    assert paths == ["/html/body/table/tbody/tr/td"] * 3 + ["/html/body/p", "/html/body/p", "/html/body/div"]


def test_labels_are_unique_texts():
    root = dom.parse("<h1>One</h1><p>two</p><p>two</p><b>it's</b><a href=x>link</a>")
    assert [t for t, _ in dom.labels(root)] == ["One"]


def test_form_parameters():
    root = dom.parse('<form id="f"><input name="q"><input type="submit" name="go"><select name="s"><option value="1"><option value="2" selected></select></form>')
    assert dom.form_parameters(root, "//form[@id]", [('//input[@name="q"]', "x y")]) == "q=x y;s=2;"
    assert dom.form_parameters(root, "//form[@class]", []) is None


def test_references_end_with_a_semicolon(spark):
    xml = dom.to_xml(dom.parse('<title>Cut &amp;amp; off &amp&quot;&#228;&nosuch; & &ampx; &am</title><a href="/x?a=1&copy=2&amp;b=3">x</a>'))
    row = spark.createDataFrame([(xml,)], "v string").select(text.node_text(F.col("v"), "//title/text()"), text.extract_url(F.col("v"), "//a")).first()
    assert list(row) == ['"Cut &amp; off &amp""ä&nosuch; & &ampx; &am"', "/x?a=1&copy=2&b=3"]


def test_titles_cut_within_a_reference(spark, tmp_path):
    import duckdb

    from webloom.queries import ORACLES, QUERIES

    pages = [(k, f"http://h.test/{k}", f"<html lang=en><head><title>{t}</title></head><body><p>x</p></body></html>") for k, t in enumerate(["a &amp; b &amp", "&amp;&am", "x &lt", "y &quot;z&quot; &a", "&lt;&gt"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name, column in (("extract_string_title", "title"), ("record_rows", "value")):
        rows = QUERIES[name](spark, str(tmp_path)).select("page_id", column).collect()
        assert sorted(map(tuple, rows)) == sorted(con.sql(f"SELECT page_id, {column} FROM ({ORACLES[name]})").fetchall()), name
