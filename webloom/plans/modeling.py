"""Inferring a site's model: pages are sampled, clustered by their paths, merged by description length, and links typed.

The loop is sequential within a site, since every step depends on the model so far, and sites are independent. A site's
group never holds the site, only the pages that the loop has asked for: a round runs the loop of each site over the pages
held so far, up to the first address that isn't there; that address, and as many of the ones that its open collections
would ask for next as the budget allows, are looked up in the store by a join for the next round. So a group holds at most
three times ``model_pages`` pages and the home page, however large the site. All places where order matters have a total
order (page address, then path). The costs are those of :mod:`webloom.operators.scoring`, which tests hold against this loop.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..functions.urls import REJECTED
from ..functions.xpathalg import Path, coarser, finer, render
from ..operators.linktypes import menu_items, menu_links, menu_types
from ..operators.scoring import COST_PATH, COST_SHARED, COST_URL, MIN_DISTANCE
from ..sources.store import Grown, stored

MAX_FETCHES = 3
#: Rows of kind page, link and item (a menu's link on the page ``url``, with its place and address).
MODEL_SCHEMA = "site string, row_kind string, class_name string, url string, xpath string, link_type string, dest string, anchor_text string, depth int, pos int, href string"


def absolute(base: str, href: str) -> str:
    try:
        rooted = base if urlsplit(base).path else base + "/"
        return urljoin(rooted, "./" + href if href.startswith("?") else href).removesuffix("/")
    except ValueError:
        return ""


def valid(base: str, href: str) -> bool:
    full = "http:" + href if href.startswith("//") else href
    if full.startswith("http"):
        try:
            if urlsplit(full).hostname != urlsplit(base).hostname:
                return False
        except ValueError:
            return False
    return not any(part in full for part in REJECTED)


def sample(links: list[str], base: str, most: int) -> list[str]:
    """First valid link, next valid one from the middle on, last valid after that; all valid ones of a short list."""
    good = [k for k, h in enumerate(links) if valid(base, h)]
    if len(links) <= most:
        return [links[k] for k in good]
    picked = good[:1]
    picked += [k for k in good if picked and k > picked[0] and k >= (len(links) - 1) // 2][:1]
    if good and picked and good[-1] > picked[-1]:
        picked.append(good[-1])
    return [links[k] for k in picked]


@dataclass(eq=False)
class Page:
    url: str
    root: dom.Node
    default: frozenset[str] = frozenset()
    current: dict[int, str] = field(default_factory=dict)
    labels: dict[str, set[str]] = field(default_factory=dict)
    classified: bool = False
    typed: list[tuple[str, str, list[tuple[str, str]], str]] = field(default_factory=list)  # xpath, type, (href, url), text

    def paths(self) -> set[str]:
        return set(self.current.values())

    def n_urls(self, collections: dict[int, Collection]) -> int:
        return len({h for k in self.current for h in collections[k].links})


@dataclass(eq=False)
class Collection:
    page: Page
    path: Path
    links: list[str]
    number: int
    refinable: bool = True
    finer: bool = False
    max_fetches: int = MAX_FETCHES
    kind: str = ""


def jaccard(a: set[str], b: set[str]) -> float:
    return len(a ^ b) / len(a | b) if a | b else math.nan


class Missing(Exception):
    """An address that the pages held so far don't cover."""


class Modeler:
    """The model of one site. ``store`` gives (final address, html) for an address, or None; with ``complete`` unset, an address that it doesn't have raises :class:`Missing`."""

    def __init__(self, site: str, store: dict[str, tuple[str, str] | None], model_pages: int, complete: bool = True):
        self.site, self.store, self.budget, self.complete = site, store, model_pages, complete
        self.pages: dict[str, Page] = {}
        self.collections: dict[int, Collection] = {}
        self.classes: dict[int, list[Page]] = {}
        self.redirects: dict[str, str] = {}
        self.fetched = 0
        self.open: list[int] = []
        self.numbers = iter(range(1, 1 << 60))

    # -- pages --

    def load(self, url: str) -> Page | None:
        if not self.complete and url not in self.store:
            raise Missing(url)
        got = self.store.get(url) or self.store.get(url + "/")
        if got is None:
            return None
        final, html = got[0] or url, got[1]
        final = final.removesuffix("/") if final.removesuffix("/") == url else final
        if final not in self.pages:
            root = dom.parse(html)
            page = Page(final, root)
            paths = {render(p): p for _, _, p in dom.links(root)}
            page.default = frozenset(paths)
            for text in sorted(paths):
                number = len(self.collections)
                self.collections[number] = Collection(page, paths[text], [n.get("href") for n in dom.select_text(root, text) if n.get("href") is not None], number)
                page.current[number] = text
            for text, p in dom.labels(root):
                page.labels.setdefault(render(p), set()).add(text)
            self.pages[final] = page
        return self.pages[final]

    def fetch(self, href: str) -> Page | None:
        url = absolute(self.site, href)
        if url in self.redirects:
            return self.pages[self.redirects[url]]
        if self.fetched >= self.budget:
            raise StopIteration
        page = self.load(url)
        if page is not None:
            self.fetched += 1
            self.redirects[url] = page.url
        return page

    # -- classes --

    @staticmethod
    def class_labels(pages: list[Page]) -> set[str]:
        have = Counter(x for p in pages for x in p.labels)
        return {x for x, n in have.items() if n > 1 and len({frozenset(p.labels[x]) for p in pages if x in p.labels}) == 1}

    def schema(self, pages: list[Page]) -> set[str]:
        return {x for p in pages for x in p.paths()} | self.class_labels(pages)

    def candidates(self, pages: list[Page]) -> list[list[Page]]:
        groups: dict[frozenset[str], list[Page]] = defaultdict(list)
        for p in dict.fromkeys(pages):
            groups[p.default].append(p)
        out = []
        for group in sorted(groups.values(), key=lambda g: min(p.url for p in g)):
            needs = self.class_labels(group)
            leave = [p for p in group if p.labels and not needs <= set(p.labels)]
            out.append([p for p in group if p not in leave])
            if leave:
                out.append(leave)
        out = sorted((c for c in out if c), key=lambda c: (-len(c), min(p.url for p in c)))
        return self.collapse(out, lambda a, b: jaccard(self.schema(a), self.schema(b)) < MIN_DISTANCE)

    @staticmethod
    def collapse(classes: list[list[Page]], near) -> list[list[Page]]:
        """Each class in turn takes in later ones that are near, the last first; its schema grows as it does."""
        left = [list(c) for c in classes]
        gone: set[int] = set()
        for i in range(len(left)):
            for j in range(len(left) - 1, i, -1):
                if i not in gone and j not in gone and near(left[i], left[j]):
                    left[i] += left[j]
                    gone.add(j)
        return [c for i, c in enumerate(left) if i not in gone]

    def cost(self, pages: list[Page], idf: dict[str, float]) -> float:
        labels = self.class_labels(pages)
        paths = {x for p in pages for x in p.paths()}
        count = Counter(x for p in pages for x in p.paths()) + Counter(x for p in pages for x in p.labels if x in labels)
        price = {x: 1 / (count[x] / len(pages) * idf.get(x, 0.0) + 1) for x in sorted(paths | labels)}
        own = sum(price[x] for x in sorted(paths)) + sum(price[x] for x in sorted(labels))
        total = own
        for p in pages:
            has, named = p.paths(), set(p.labels) & labels
            total += COST_URL * p.n_urls(self.collections)
            total += sum((COST_SHARED if x in has else COST_PATH) * price[x] for x in sorted(paths))
            total += sum((COST_SHARED if x in named else COST_PATH) * price[x] for x in sorted(labels))
        return total

    def idf(self) -> dict[str, float]:
        df = Counter(x for p in self.pages.values() for x in p.paths() | set(p.labels))
        return {x: math.log(len(self.pages) / n) for x, n in df.items()}

    def place(self, candidate: list[Page]) -> None:
        """As a class of its own, or merged into the class for which the model's cost falls most."""
        idf = self.idf()
        alone = self.cost(candidate, idf)
        best, least = None, -1e-9
        for number in sorted(self.classes):
            pages = self.classes[number]
            delta = self.cost(pages + candidate, idf) - self.cost(pages, idf) - alone
            if delta < least:
                best, least = number, delta
        if best is None:
            self.classes[next(self.numbers)] = list(candidate)
        else:
            self.classes[best] = self.classes[best] + candidate
        for p in candidate:
            p.classified = True

    # -- the loop --

    def priority(self, c: Collection) -> tuple:
        own = next((ps for ps in self.classes.values() if c.page in ps), [c.page])
        out = {h for p in own for k in p.current for h in self.collections[k].links}
        return (len(own) != 1, -len(c.links) / max(1, len(out)), c.page.url, render(c.path), c.number)

    def refine(self, c: Collection) -> bool:
        """The next version of the path that gives other links, fewer than the page has addresses."""
        step, path, most = finer if c.finer else coarser, c.path, c.page.n_urls(self.collections)
        while (path := step(path)) is not None:
            found = [n.get("href") for n in dom.select(c.page.root, path) if n.get("href") is not None]
            if found != c.links and len(set(found)) < most:
                c.path, c.links = path, found
                c.page.current[c.number] = render(path)
                return True
        c.refinable = False
        return False

    def explore(self, c: Collection) -> tuple[list[tuple[str, Page]], list[list[Page]]]:
        """Fetch, cluster and type one collection; StopIteration when the budget is used up."""
        while True:
            found = [(h, p) for h in sample(c.links, self.site, c.max_fetches) if (p := self.fetch(h)) is not None]
            if not found:
                return [], []
            groups = self.candidates([p for _, p in found])
            n, k = len(found), len(groups)
            while True:
                again = False
                if n == 3 and k > 1 and c.refinable:
                    c.finer = True
                    again = self.refine(c)
                    if not again:
                        continue  # typed anew, now that it can't be refined
                elif n == 3:
                    c.kind = "list" if k < 3 else "menu"
                    if k >= 3 and len(c.links) > 3 and c.max_fetches == MAX_FETCHES:
                        c.max_fetches, again = len(c.links), True
                elif n == 2:
                    c.kind = "list" if k == 1 else "menu"
                elif n == 1:
                    if c.refinable and not c.finer:
                        again = self.refine(c)
                        if not again:
                            continue
                    else:
                        c.kind = "singleton"
                break
            if not again:
                return found, groups

    def run(self) -> None:
        start = self.load(self.site)
        if start is None:
            return
        self.classes[next(self.numbers)] = [start]
        start.classified = True
        self.open = open_ = list(start.current)
        try:
            while open_:
                number = min(open_, key=lambda k: self.priority(self.collections[k]))
                open_.remove(number)
                c = self.collections[number]
                found, groups = self.explore(c)
                fresh = list(dict.fromkeys(p for _, p in found if not p.classified))
                for group in groups:
                    if rest := [p for p in group if not p.classified]:
                        self.place(rest)
                if c.kind and found:
                    text = next((" ".join(n.text().split()) for n in dom.select(c.page.root, c.path)), "") if c.kind == "singleton" else ""
                    c.page.typed.append((render(c.path), c.kind, [(h, p.url) for h, p in found], text))
                for p in fresh:
                    open_ += list(p.current)
        except StopIteration:  # pages fetched for the last collection stay without a class
            pass

    def wanted(self, first: str, most: int) -> list[str]:
        """Addresses to look up: ``first``, then what the open collections would ask for, the next ones first; at most ``most`` and one."""
        out = {first: None}
        for number in sorted(self.open, key=lambda k: self.priority(self.collections[k])):
            c = self.collections[number]
            for href in sample(c.links, self.site, c.max_fetches):
                url = absolute(self.site, href)
                if len(out) <= most and url not in self.store:
                    out[url] = None
        return list(out)

    # -- the result --

    def graph(self) -> dict[tuple[int, str], tuple[str, list[int], str]]:
        """(class, path) → type, destinations, text: lists before menus before singletons."""
        owner = {p.url: k for k, ps in self.classes.items() for p in ps}
        order = {"list": 0, "menu": 1, "singleton": 2}
        out: dict[tuple[int, str], tuple[str, list[int], str]] = {}
        for k in sorted(self.classes):
            for p in sorted(self.classes[k], key=lambda p: p.url):
                for xpath, kind, links, text in p.typed:
                    dests = list(dict.fromkeys(owner[u] for _, u in links if u in owner))
                    if not dests:
                        continue
                    kind = "list" if kind == "menu" and len(dests) == 1 else kind
                    held = out.get((k, xpath))
                    if held is None or order[kind] < order[held[0]]:
                        out[k, xpath] = (kind, dests if kind == "menu" else dests[:1], text)
                    elif kind == "menu" and held[0] == "menu":
                        out[k, xpath] = (kind, list(dict.fromkeys(held[1] + dests)), "")
        return out

    def finish(self) -> None:
        """Collapse classes by schema, then by their links in the graph."""
        for by_links in (False, True):
            order = sorted(self.classes)
            if by_links:
                around: dict[int, set[tuple[str, str]]] = defaultdict(set)
                for (k, xpath), (kind, dests, _) in self.graph().items():
                    for d in dests:
                        around[k].add((xpath, kind))
                        around[d].add((xpath, kind))
                at = {min(p.url for p in ps): k for k, ps in self.classes.items()}

                def near(a: list[Page], b: list[Page], at: dict = at, around: dict = around) -> bool:
                    return jaccard(around[at[a[0].url]] if a[0].url in at else set(), around[at[b[0].url]] if b[0].url in at else set()) < MIN_DISTANCE

                merged = self.collapse([sorted(self.classes[k], key=lambda p: p.url) for k in order], near)
            else:
                merged = self.collapse([self.classes[k] for k in order], lambda a, b: jaccard(self.schema(a), self.schema(b)) < MIN_DISTANCE)
            first = {p.url: k for k in order for p in self.classes[k]}
            self.classes = {first[m[0].url]: m for m in merged}

    def rows(self) -> list[tuple]:
        graph = self.graph()
        names = {k: f"class{n + 1}" for n, k in enumerate(sorted(self.classes))}
        depth = {min(self.classes): 0} if self.classes else {}
        level = list(depth)
        while level:
            nxt = []
            for (k, _), (_, dests, _) in sorted(graph.items()):
                if k in level:
                    for d in dests:
                        if d not in depth:
                            depth[d] = depth[k] + 1
                            nxt.append(d)
            level = nxt
        out = []
        for k in sorted(self.classes):
            for p in sorted(self.classes[k], key=lambda p: p.url):
                out.append((self.site, "page", names[k], p.url, None, None, None, None, depth.get(k), None, None))
        for (k, xpath), (kind, dests, text) in sorted(graph.items()):
            for d in dests:
                out.append((self.site, "link", names[k], None, xpath, kind, names[d], text if kind == "singleton" else None, depth.get(k), None, None))
        owner = {p.url: k for k, ps in self.classes.items() for p in ps}
        for k in sorted(self.classes):
            for p in sorted(self.classes[k], key=lambda p: p.url):
                for xpath, kind, links, _ in p.typed:
                    if kind == "menu" and graph.get((k, xpath), ("",))[0] == "menu":
                        out += [(self.site, "item", names[k], p.url, xpath, "menu", names[owner[u]], None, depth.get(k), n, h) for n, (h, u) in enumerate(links) if u in owner]
        return out


COLUMNS = ["site", "row_kind", "class_name", "url", "xpath", "link_type", "dest", "anchor_text", "depth", "pos", "href"]
#: A page's rows in the loop: ``key`` is the address without a slash at its end; an address that nothing answers has no html.
HELD = "site string, key string, url string, final_url string, html string"


def build_models(store: DataFrame, model_pages: int = 100, sites: DataFrame | None = None) -> DataFrame:
    """Models of the sites of a page store, as rows: pages with their class, links with type and destination, items of menus.

    The seed of a site is its own address. ``model_pages`` bounds what is fetched of a site; ``sites`` (site, and
    model_pages where sites have budgets of their own) says which sites, by default all of the store.
    """
    spark = store.sparkSession
    asked = sites if sites is not None else store.select("site").distinct()
    budget = F.col("model_pages") if "model_pages" in asked.columns else F.lit(model_pages)
    wanted = stored(asked.select("site", F.coalesce(budget, F.lit(model_pages)).cast("int").alias("most"), F.regexp_replace("site", "/$", "").alias("key")), "wanted-pages")
    answers = store.filter(F.col("html").isNotNull()).select("site", F.regexp_replace("url", "/$", "").alias("key"), "url", "final_url", "html")
    held, models = Grown(spark, HELD + ", most int", "held-pages"), Grown(spark, MODEL_SCHEMA, "models")

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        site, most = str(pdf["site"].iloc[0]), int(pdf["most"].iloc[0])
        pages: dict[str, tuple[str, str] | None] = {}
        for key, _, final, html in sorted(zip(pdf["key"], pdf["url"].fillna(""), pdf["final_url"].fillna(""), pdf["html"], strict=True), key=lambda r: r[:2]):
            pages[key] = (final, html) if html is not None else pages.get(key)
        modeler = Modeler(site, pages, most, complete=False)
        try:
            modeler.run()
            modeler.finish()
            rows = modeler.rows()
        except Missing as missing:
            room = 2 * most - sum(p is not None for p in pages.values())
            rows = [(site, "wanted", None, url, *[None] * 7) for url in modeler.wanted(missing.args[0], room)]
        return pd.DataFrame(rows, columns=COLUMNS).astype({"depth": "Int32", "pos": "Int32"})

    while not wanted.isEmpty():
        found = wanted.select("site", "key", "most").distinct().join(answers, ["site", "key"], "left")
        held.append(found)
        # only sites that asked for something run again
        rows = stored(held.table().join(wanted.select("site").distinct(), "site", "left_semi").groupBy("site").applyInPandas(step, MODEL_SCHEMA), "model-rows")
        models.append(rows.filter("row_kind <> 'wanted'"))
        more = rows.filter("row_kind = 'wanted'").select("site", F.regexp_replace("url", "/$", "").alias("key"))
        wanted = stored(more.join(wanted.select("site", "most").distinct(), "site"), "wanted-pages")
    return models.table()


def model_links(rows: DataFrame) -> DataFrame:
    """Class links of models (site, src, xpath, link_type, dest, anchor_text, depth), to be followed by a crawl.

    Menus give a link for each item: by its address where the menu is the same on all pages, by its place where it isn't.
    """
    single = rows.filter("row_kind = 'link' AND link_type <> 'menu'").select("site", F.col("class_name").alias("src"), "xpath", "link_type", "dest", "anchor_text", "depth")
    of_site = F.concat_ws("\n", "site", "class_name")
    items = menu_items(rows.filter("row_kind = 'item'").select(of_site.alias("class_name"), "xpath", "dest", F.col("url").alias("src_page"), "pos", "href"))
    depth = rows.filter("row_kind = 'item'").select(of_site.alias("of_site"), "depth").distinct()
    menus = menu_links(items, menu_types(items)).join(depth, F.col("src") == F.col("of_site"))
    parts = F.split("src", "\n")
    return single.unionByName(menus.select(parts[0].alias("site"), parts[1].alias("src"), "xpath", "link_type", "dest", F.lit(None).cast("string").alias("anchor_text"), "depth"))
