"""Guided traversal: follow only the links that a model names, label each URL with its class, extract records.

A crawl is a loop of rounds, until the frontier is empty. A round takes each site's best URLs within the site's budget,
joins the page store, evaluates the model's paths (one column a path, whatever classes have it: models have tens), and puts links that are new into
the frontier. What rounds find is appended to tables in the shared folder; only what is left of the frontier is written
anew. The model is small and is read by the driver to make the columns.

A link of type form leads to the address of its page and the form's parameters, ``address>k=v;``. Such an address is
posted, and the page is known by the address that answers. A class may have a form itself: then its address is fetched,
the form's parameters are read from the page, and they are posted to the same address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import frontier as fr
from ..sources.pages import dispatch, fetch, form_parameters, with_xml
from ..sources.store import Grown, stored

FRONTIER = "site string, url string, form_params string, class_name string, depth int, attempts int, key string"


@dataclass
class Crawl:
    url_class: DataFrame  # site, url, class_name, round
    records: DataFrame  # site, class_name, url, record
    failed: DataFrame  # site, url, class_name
    pages: DataFrame  # site, url, class_name, html: what was fetched, if asked for


def out_links(pages: DataFrame, links: list[tuple[str, str, str]], base: str = "site") -> DataFrame:
    """(site, page, class_name, xpath, pos, link, dest): valid links of fetched pages, absolute, in document order.

    ``links``: (class, xpath, destination); ``base``: resolve against the ``site`` root or the ``page``.
    """
    if not links:
        return pages.select("site", F.col("url").alias("page"), "class_name", F.lit("").alias("xpath"), F.lit(0).alias("pos"), F.lit("").alias("link"), F.lit("").alias("dest")).limit(0)

    paths = list(dict.fromkeys(x for _, x, _ in links))

    def found(k: int, path: str) -> Column:
        hrefs = F.when(F.col("class_name").isin(*{c for c, x, _ in links if x == path}), text.hrefs(F.col("xml"), path))
        return F.coalesce(F.transform(hrefs, lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), h.alias("href"))), F.array().cast("array<struct<k:int,pos:int,href:string>>"))

    # one step from a page to its links: a row that kept the page's list beside each link would grow with the square of the list
    every = F.flatten(F.array(*[found(k, x) for k, x in enumerate(paths)]))
    rows = pages.select("site", F.col("url").alias("page"), "class_name", F.inline(every))
    model = pages.sparkSession.createDataFrame([(c, paths.index(x), x, d) for c, x, d in links], "class_name string, k int, xpath string, dest string")
    rows = rows.join(F.broadcast(model), ["class_name", "k"])  # as small as the driver's list
    at = F.col("site") if base == "site" else F.col("page")
    return rows.filter(urls.is_valid_url(F.col("site"), F.col("href"))).select("site", "page", "class_name", "xpath", "pos", urls.absolute_url(at, F.col("href")).alias("link"), "dest").filter("link <> ''")


def records(pages: DataFrame, data: list[tuple[str, str, str]]) -> DataFrame:
    """(site, class_name, url, record) of pages whose class has data; ``data``: (class, kind, xpath) in record order."""
    fields: dict[str, list[tuple[str, str]]] = {}
    for c, kind, path in data:
        if text.extract(kind, F.col("xml"), path) is not None:
            fields.setdefault(c, []).append((kind, path))
    classes: dict[tuple, list[str]] = {}  # classes with the same fields share columns
    for c, its in fields.items():
        classes.setdefault(tuple(its), []).append(c)
    record = F.lit(None).cast("array<string>")
    for its, names in classes.items():
        record = F.when(F.col("class_name").isin(*names), F.array(*[text.extract(kind, F.col("xml"), path) for kind, path in its])).otherwise(record)
    return pages.select("site", "class_name", "url", record.alias("record")).filter(F.col("record").isNotNull())


def by_path(rows: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Classes by path: those of sites with the same model share a column, or a pass over the pages."""
    found: dict[str, list[str]] = {}
    for c, path in dict.fromkeys(rows):
        found.setdefault(path, []).append(c)
    return found


def answer(requests: DataFrame, store: DataFrame, forms: list[tuple[str, str]] = ()) -> DataFrame:
    """Requests with code, html and ``page``, the address that the page is known by.

    ``forms``: (class, path of its form).
    """
    own = F.lit(None).cast("string")
    for path, classes in by_path(forms).items():
        own = F.when(F.col("class_name").isin(*classes), path).otherwise(own)
    # a form's parameters are part of the address until here
    marked = dispatch(requests.withColumns({"asked": F.col("url"), "class_form": own, "url": F.concat("url", F.coalesce(F.concat(F.lit(">"), "form_params"), F.lit("")))}))
    marked = marked.withColumns({"url": F.col("asked"), "form_params": F.when(F.col("mode") == "post", F.col("params"))}).drop("asked", "address", "params")
    found = fetch(marked.drop("html", "final_url", "code"), store)
    if forms:
        first = stored(found.filter("mode = 'get_post'"), "form-pages")
        rows = [form_parameters(first.filter(F.col("class_name").isin(*classes)), path, [], "site", "url", "class_name") for path, classes in by_path(forms).items()]
        params = rows[0]
        for r in rows[1:]:
            params = params.unionByName(r)
        keys = ["site", "url", "class_name"]
        again = first.drop("form_params", "html", "final_url", "code").join(params.withColumnRenamed("params", "form_params"), keys, "left")
        posted = fetch(again, store)  # a page without the form has nothing to post
        posted = posted.withColumns({"code": F.when(F.col("form_params").isNull(), 1).otherwise(F.col("code")), "form_params": F.lit(None).cast("string")})
        found = found.filter("mode <> 'get_post'").unionByName(posted.select(found.columns))
    return found.withColumn("page", F.when((F.col("mode") == "post") & F.col("final_url").isNotNull(), F.col("final_url")).otherwise(F.col("url"))).drop("class_form")


def form_links(pages: DataFrame, links: list[tuple[str, str, str]]) -> DataFrame:
    """(site, class_name, xpath, url, form_params, dest) of the pages' forms; ``links``: (class, path, destination)."""
    out = pages.select("site", "url", "class_name").limit(0).select("site", "class_name", F.lit("").alias("xpath"), "url", F.lit("").alias("form_params"), F.lit("").alias("dest"))
    for path, classes in by_path([(c, x) for c, x, _ in links]).items():
        rows = form_parameters(pages.filter(F.col("class_name").isin(*classes)), path, [], "site", "url", "class_name")
        leads = pages.sparkSession.createDataFrame([(c, d) for c, x, d in links if x == path], "class_name string, dest string")
        rows = rows.join(F.broadcast(leads), "class_name")  # as small as the driver's list
        out = out.unionByName(rows.select("site", "class_name", F.lit(path).alias("xpath"), "url", F.col("params").alias("form_params"), "dest"))
    return out


def crawl(
    store: DataFrame, seeds: DataFrame, links: DataFrame, data: DataFrame, depths: DataFrame, *, forms: DataFrame | None = None, per_round: int = 1_000_000, budget: int = 1_000_000,
    max_failures: int = 1, base: str = "site", most_rounds: int | None = None, keep_pages: bool = False,
) -> Crawl:
    """Crawl a page store from ``seeds`` (site, url, class_name) until the frontier is empty or each site's budget is used.

    ``links``: (src, xpath, dest), with link_type where some are forms; ``data``: (class_name, ord, xpath, data_type);
    ``depths``: (name, depth) of classes; ``forms``: (class_name, form) of classes that are reached by their own form.
    ``budget``: pages of a site; ``per_round``: URLs of a site in a round; a URL that fails is tried again up to ``max_failures``
    times. ``seeds`` may have columns budget and max_failures for sites with limits of their own (null: the general one).
    ``most_rounds``: the caller's own limit; if URLs are left when it is reached, that is an error.
    """
    spark: SparkSession = store.sparkSession
    kind = F.col("link_type") if "link_type" in links.columns else F.lit("")
    every = [tuple(r) for r in links.select("src", "xpath", "dest", (kind == "form").alias("form")).distinct().orderBy("src", "xpath", "dest").collect()]
    known_links, known_forms = [(c, x, d) for c, x, d, form in every if not form], [(c, x, d) for c, x, d, form in every if form]
    known_data = [tuple(r) for r in data.orderBy("class_name", "ord").select("class_name", "data_type", "xpath").collect()]
    own_forms = [tuple(r) for r in forms.select("class_name", "form").distinct().orderBy("class_name", "form").collect()] if forms is not None else []
    depth = depths.select(F.col("name").alias("class_name"), "depth")
    with_html = bool(known_forms) or keep_pages
    no_params = F.lit(None).cast("string")

    def own(column: str, general: int) -> Column:
        return F.coalesce(F.max(column) if column in seeds.columns else F.lit(None).cast("int"), F.lit(general)).alias(column)

    limits = stored(seeds.groupBy("site").agg(own("budget", budget), own("max_failures", max_failures)), "limits")
    columns = spark.createDataFrame([], FRONTIER).columns
    start = fr.dedupe(seeds.select("site", "url", no_params.alias("form_params"), "class_name").join(depth, "class_name"), spark.createDataFrame([], "site string, key string"))
    frontier = stored(start.withColumn("attempts", F.lit(0)).select(columns), "frontier")
    visited = Grown(spark, "site string, key string", "visited")
    visited.append(frontier)
    done = Grown(spark, "site string, url string, class_name string, round int", "url-class")
    made = Grown(spark, "site string, class_name string, url string, record array<string>", "records")
    lost = Grown(spark, "site string, url string, class_name string", "failed")
    kept = Grown(spark, "site string, url string, class_name string, html string", "pages")
    number = 0
    while True:
        used = done.table().groupBy("site").agg(F.count("*").alias("used"))
        left = limits.join(used, "site", "left").select("site", "max_failures", (F.col("budget") - F.coalesce("used", F.lit(0))).alias("left"))
        # the limit of a round bounds each site's rows before they are shuffled, the budget after it
        taken = stored(fr.top_k_by_site(frontier, per_round).join(left, "site").filter(F.col("nth") <= F.col("left")).drop("nth", "left"), "taken")
        if taken.isEmpty():
            break
        if most_rounds is not None and number >= most_rounds:
            raise RuntimeError(f"URLs are left after {most_rounds} rounds")
        rest = frontier.join(taken.select("site", "key"), ["site", "key"], "left_anti")
        answers = with_xml(answer(taken, store, own_forms))
        answers = stored(answers if with_html else answers.drop("html"), "pages")
        good = answers.filter("code = 0").withColumn("url", F.col("page"))
        bad = answers.filter("code <> 0").withColumn("attempts", F.col("attempts") + 1)
        done.append(good.withColumn("round", F.lit(number)))
        made.append(records(good, known_data))
        lost.append(bad.filter(F.col("attempts") > F.col("max_failures")))
        if keep_pages:
            kept.append(good)
        found = out_links(good, known_links, base).select("site", F.col("link").alias("url"), no_params.alias("form_params"), F.col("dest").alias("class_name"))
        if known_forms:
            found = found.unionByName(form_links(good, known_forms).select("site", "url", "form_params", F.col("dest").alias("class_name")))
        fresh = stored(fr.dedupe(found.join(depth, "class_name"), visited.table()).withColumn("attempts", F.lit(0)).select(columns), "fresh")
        visited.append(fresh)
        again = bad.filter(F.col("attempts") <= F.col("max_failures"))
        frontier = stored(rest.select(columns).unionByName(again.select(columns)).unionByName(fresh), "frontier")
        number += 1
    return Crawl(done.table(), made.table(), lost.table(), kept.table())
