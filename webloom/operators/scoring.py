"""Distances and costs of classes: set distances over paths, inverse document frequency, the description-length cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

#: Cost of a URL, of a path that a page shares with its class, and of any other path.
COST_URL, COST_SHARED, COST_PATH = 1.0, 0.8, 1.0
MIN_DISTANCE = 0.2
#: Keys of equal sets that go together, about.
CHUNK = 500
#: Pairs of keys that a task makes, about.
PAIRS_A_TASK = 4_000_000


def jaccard(a: Column, b: Column) -> Column:
    """Share of the elements that only one set has; null for two empty sets."""
    return F.try_divide((F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def pair_overlaps(members: DataFrame, key: str, element: str) -> DataFrame:
    """a < b and the number of shared elements for all keys that share one: an equi-join on the element, no cross join."""
    left, right = members.select(F.col(key).alias("a"), F.col(element).alias("_e")).distinct(), members.select(F.col(key).alias("b"), F.col(element).alias("_f")).distinct()
    return left.join(right, (F.col("_e") == F.col("_f")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("shared"))


def jaccard_pairs(members: DataFrame, key: str, element: str) -> DataFrame:
    """Distance of every two keys that share an element; all others are at distance 1."""
    sizes = members.select(key, element).distinct().groupBy(key).agg(F.count("*").alias("n"))
    pairs = pair_overlaps(members, key, element)
    rows = pairs.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    all_ = F.col("na") + F.col("nb") - F.col("shared")
    return rows.select("a", "b", "shared", ((all_ - F.col("shared")) / all_).alias("distance"))


def close_pairs(members: DataFrame, key: str, element: str, below: float) -> DataFrame:
    """Pairs a < b of keys that could be at a distance below ``below``, found by their rarest elements.

    Sets that near share at least 1 - below of either, so in any one order of all elements they share one of the first
    n - ceil((1 - below) n) + 1. Rare ones come first: an element that all keys have makes no pairs of its own.
    """
    rows = members.select(F.col(key).alias("k"), F.col(element).alias("e")).distinct()
    ranked = rows.join(rows.groupBy("e").agg(F.count("*").alias("df")), "e")
    own = Window.partitionBy("k")
    ranked = ranked.withColumns({"nth": F.row_number().over(own.orderBy("df", "e")), "n": F.count("*").over(own)})
    first = ranked.filter(F.col("nth") <= F.col("n") - F.ceil((1 - below) * F.col("n") - 1e-9) + 1)
    a, b = first.select(F.col("k").alias("a"), "e", F.col("n").alias("na")), first.select(F.col("k").alias("b"), F.col("e").alias("_e"), F.col("n").alias("nb"))
    sizes = F.least("na", "nb") >= (1 - below) * F.greatest("na", "nb") - 1e-9
    return a.join(b, (F.col("e") == F.col("_e")) & (F.col("a") < F.col("b")) & sizes).select("a", "b", "na", "nb").distinct()


def equal_sets(members: DataFrame, key: str, element: str) -> tuple[DataFrame, DataFrame]:
    """(k, s) of each key, with s the first key of an equal set, and (s, elements, n) of each distinct set.

    n counts a null element, which no two sets share and ``elements`` doesn't have.
    """
    null = F.max(F.col(element).isNull().cast("int"))
    sets = members.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_set(element)).alias("elements"), null.alias("_null"))
    sets = stored(sets.withColumn("n", (F.size("elements") + F.col("_null")).cast("long")), "sets")
    same = ["elements", "n"]
    distinct = stored(sets.groupBy(*same).agg(F.min("k").alias("s"), F.count("*").alias("keys")), "distinct-sets")
    # one row a key and one a distinct set meet by the set's hash; the sets are compared whole
    digest = F.xxhash64("n", "elements").alias("h")
    left, right = sets.select("k", digest, *same), distinct.select("s", "keys", digest, F.col("elements").alias("_e"), F.col("n").alias("_n"))
    of_key = left.join(right, (left["h"] == right["h"]) & (F.col("elements") == F.col("_e")) & (F.col("n") == F.col("_n"))).select("k", "s", "keys")
    return of_key, distinct.select("s", "elements", "n")


def expanded(of_key: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs a < b of keys from pairs (x, y, ...) of sets, each pair of sets once, x = y for pairs within a set; the other columns follow.

    The keys of a set go in chunks, and a pair of chunks becomes pairs of keys where it is read: nothing is shuffled by
    pairs of keys, and many equal sets are no single task.
    """
    chunk = F.pmod(F.xxhash64("k"), F.lit(1) + F.floor(F.col("keys") / CHUNK)).cast("int").alias("c")
    chunks = stored(of_key.groupBy("s", chunk).agg(F.array_sort(F.collect_list("k")).alias("ks")), "chunks")
    kept = [c for c in found.columns if c not in ("x", "y")]
    left, right = chunks.select(F.col("s").alias("x"), F.col("c").alias("cx"), F.col("ks").alias("kx")), chunks.select(F.col("s").alias("y"), F.col("c").alias("cy"), F.col("ks").alias("ky"))
    both = found.join(left, "x").join(right, "y").filter((F.col("x") < F.col("y")) | (F.col("x") > F.col("y")) | (F.col("cx") <= F.col("cy")))
    alone = (F.col("x") == F.col("y")) & (F.col("cx") == F.col("cy"))
    both = stored(both.select("kx", "ky", alone.alias("alone"), *kept), "chunk-pairs")
    rows = both.agg(F.sum(F.size("kx").cast("long") * F.size("ky"))).first()[0] or 0
    both = both.repartition(1 + rows // PAIRS_A_TASK, F.xxhash64("kx", "ky"))  # by number: the few bytes would go to one task
    pairs = both.select(F.explode("kx").alias("p"), "ky", "alone", *kept).select("p", F.explode("ky").alias("q"), "alone", *kept).filter(~F.col("alone") | (F.col("p") < F.col("q")))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *kept)


def collapse_pairs(members: DataFrame, key: str, element: str, below: float = MIN_DISTANCE) -> DataFrame:
    """Pairs at a distance below ``below``, with the number of shared elements.

    Equal sets are compared once, whatever keys have them, and of those only candidates are compared in full.
    """
    of_key, sets = equal_sets(members, key, element)
    rows = sets.select("s", F.explode(F.when(F.size("elements") < F.col("n"), F.concat("elements", F.array(F.lit(None)))).otherwise(F.col("elements"))).alias("e"))
    near = close_pairs(rows, "s", "e", below).select(F.col("a").alias("x"), F.col("b").alias("y"))
    for side in ("x", "y"):
        near = near.join(sets.select(F.col("s").alias(side), F.col("elements").alias(f"e{side}"), F.col("n").alias(f"n{side}")), side)
    near = near.select("x", "y", "nx", "ny", F.size(F.array_intersect("ex", "ey")).cast("long").alias("shared"))
    within = sets.select(F.col("s").alias("x"), F.col("s").alias("y"), F.col("n").alias("nx"), F.col("n").alias("ny"), F.size("elements").cast("long").alias("shared"))
    all_ = F.col("nx") + F.col("ny") - F.col("shared")
    found = near.unionByName(within).filter("shared > 0").select("x", "y", "shared", ((all_ - F.col("shared")) / all_).alias("distance"))
    return expanded(of_key, found.filter(F.col("distance") < below)).select("a", "b", "shared", "distance")


def link_graph_elements(links: DataFrame) -> DataFrame:
    """(class_name, element) of each class's outgoing and incoming links; an element is path and type."""
    element = F.concat_ws("\t", "xpath", "link_type")
    return links.select(F.col("src").alias("class_name"), element.alias("element")).union(links.select(F.col("dest"), element)).distinct()


def idf(occurrences: DataFrame, page: str = "page") -> DataFrame:
    """xpath and ln(pages / pages with it); ``occurrences``: (page, xpath), pages counted over all rows."""
    rows = occurrences.select(page, "xpath").distinct()
    total = rows.select(page).distinct().agg(F.count("*").alias("pages"))
    return rows.groupBy("xpath").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("xpath", F.log(F.col("pages") / F.col("df")).alias("idf"))


def tfidf(occurrences: DataFrame) -> DataFrame:
    """class_id, xpath and (share of the class's pages with it) * idf; ``occurrences``: (class_id, page, xpath)."""
    rows = occurrences.select("class_id", "page", "xpath").distinct()
    size = rows.select("class_id", "page").distinct().groupBy("class_id").agg(F.count("*").alias("size"))
    share = rows.groupBy("class_id", "xpath").agg(F.count("*").alias("n")).join(size, "class_id")
    return share.join(idf(rows), "xpath").select("class_id", "xpath", (F.col("n") / F.col("size") * F.col("idf")).alias("tfidf"))


def page_costs(links: DataFrame, urls: DataFrame, labels: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Cost of each page given its class: shared paths, its URLs, and the class's paths that it lacks.

    ``links``: (class_id, page, xpath); ``urls``: (page, n) distinct URLs of a page; ``labels``: (class_id, page, xpath) of
    class labels that a page has; ``weights``: (class_id, xpath, tfidf), by default from links and labels.
    """
    rows = links.select("class_id", "page", "xpath", F.lit(True).alias("is_link")).distinct()
    if labels is not None:
        rows = rows.union(labels.select("class_id", "page", "xpath", F.lit(False)).distinct())
    w = weights if weights is not None else tfidf(rows)
    pages = rows.select("class_id", "page").distinct()
    priced = w.withColumn("price", 1 / (F.col("tfidf") + 1))
    kinds = rows.select("class_id", "xpath", "is_link").distinct().join(priced, ["class_id", "xpath"])
    # all paths of the class at the price of lacking them, corrected for those that the page has
    whole = kinds.groupBy("class_id").agg((F.sum("price") * COST_PATH).alias("lacking"))
    had = rows.join(kinds, ["class_id", "xpath", "is_link"]).groupBy("class_id", "page").agg(F.sum("price").alias("had"))
    joined = pages.join(whole, "class_id").join(had, ["class_id", "page"], "left").join(urls, "page", "left")
    cost = F.col("lacking") - (COST_PATH - COST_SHARED) * F.coalesce("had", F.lit(0.0)) + COST_URL * F.coalesce("n", F.lit(0))
    return joined.select("class_id", "page", cost.alias("cost"))


def class_costs(links: DataFrame, urls: DataFrame, labels: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Cost of each class: the price of its paths and the costs of its pages."""
    rows = links.select("class_id", "page", "xpath", F.lit(True).alias("is_link")).distinct()
    if labels is not None:
        rows = rows.union(labels.select("class_id", "page", "xpath", F.lit(False)).distinct())
    w = weights if weights is not None else tfidf(rows)
    own = rows.select("class_id", "xpath", "is_link").distinct().join(w, ["class_id", "xpath"]).groupBy("class_id").agg(F.sum(1 / (F.col("tfidf") + 1)).alias("own"))
    pages = page_costs(links, urls, labels, w).groupBy("class_id").agg(F.sum("cost").alias("pages"))
    return own.join(pages, "class_id").select("class_id", (F.col("own") + F.col("pages")).alias("cost"))


def model_cost(links: DataFrame, urls: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    return class_costs(links, urls, labels).agg(F.sum("cost").alias("cost"))


def path_counts(links: DataFrame) -> DataFrame:
    """(class_id, xpath, n): pages of the class with the path. All that a class's cost needs besides its size and URLs."""
    return links.groupBy("class_id", "xpath").agg(F.countDistinct("page").alias("n"))


def merge_deltas(links: DataFrame, urls: DataFrame, pairs: DataFrame) -> DataFrame:
    """What merging each pair (a, b) of classes adds to the model's cost; merging pays where it is negative.

    Costs add up over classes, so only the pair's own costs enter, and a class's cost follows from its path counts: the
    price of each path, once for the class and once for each page, less a fifth for the pages that have it. So a
    pair costs as many rows as its two classes have paths, however many pages they have. Frequencies over all
    pages stay as they are.
    """
    base = idf(links.select("page", "xpath"))
    counts = path_counts(links).join(base, "xpath")
    of_page = links.select("class_id", "page").distinct().join(urls, "page", "left")
    sizes = of_page.groupBy("class_id").agg(F.count("*").alias("size"), F.sum(COST_URL * F.coalesce("n", F.lit(0))).alias("urls"))

    def cost(size: Column) -> Column:
        price = 1 / (F.col("n") / size * F.col("idf") + 1)
        return F.sum(price * (1 + COST_PATH * size - (COST_PATH - COST_SHARED) * F.col("n")))

    single = counts.join(sizes, "class_id").groupBy("class_id", "size", "urls").agg(cost(F.col("size")).alias("cost"))
    both = pairs.select("a", "b")
    for side in ("a", "b"):
        both = both.join(single.select(F.col("class_id").alias(side), F.col("size").alias(f"size_{side}"), F.col("cost").alias(f"cost_{side}")), side)
    keys = ["a", "b", "size_a", "size_b", "cost_a", "cost_b"]
    members = both.select(*keys, F.explode(F.array("a", "b")).alias("class_id"))
    joint = members.join(counts, "class_id").groupBy(*keys, "xpath").agg(F.sum("n").alias("n"), F.first("idf").alias("idf"))
    merged = joint.groupBy(*keys).agg(cost(F.col("size_a") + F.col("size_b")).alias("joint"))
    # the URLs' cost is the same before and after
    return merged.select("a", "b", (F.col("joint") - F.col("cost_a") - F.col("cost_b")).alias("delta"))


def weighted(links: DataFrame, frequency: DataFrame) -> DataFrame:
    """(class_id, xpath, tfidf) with a given idf."""
    rows = links.select("class_id", "page", "xpath").distinct()
    size = rows.select("class_id", "page").distinct().groupBy("class_id").agg(F.count("*").alias("size"))
    return rows.groupBy("class_id", "xpath").agg(F.count("*").alias("n")).join(size, "class_id").join(frequency, "xpath").select("class_id", "xpath", (F.col("n") / F.col("size") * F.col("idf")).alias("tfidf"))


def weighted_distance(members: DataFrame) -> DataFrame:
    """Distance of every two classes that share a path, paths weighted: difference over difference and intersection.

    ``members``: (class_id, xpath, tfidf). A path of one class counts 1 + tfidf, a shared one 2 + both tfidf.
    """
    whole = members.groupBy("class_id").agg(F.sum(1 + F.col("tfidf")).alias("all"))
    a = members.select(F.col("class_id").alias("a"), "xpath", F.col("tfidf").alias("ta"))
    b = members.select(F.col("class_id").alias("b"), F.col("xpath").alias("_x"), F.col("tfidf").alias("tb"))
    inter = a.join(b, (F.col("xpath") == F.col("_x")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.sum(2 + F.col("ta") + F.col("tb")).alias("inter"))
    rows = inter.join(whole.select(F.col("class_id").alias("a"), F.col("all").alias("wa")), "a").join(whole.select(F.col("class_id").alias("b"), F.col("all").alias("wb")), "b")
    diff = F.col("wa") + F.col("wb") - F.col("inter")
    return rows.select("a", "b", (diff / (diff + F.col("inter"))).alias("distance"))


def subset_pairs(members: DataFrame, key: str, element: str) -> DataFrame:
    """Pairs of which one set holds the other; empty sets take no part.

    Equal sets are compared once, whatever keys have them. A smaller set meets those that have its rarest element, and
    is compared with them in full; a null element is in no other set.
    """
    of_key, sets = equal_sets(members, key, element)
    whole = sets.filter((F.size("elements") == F.col("n")) & (F.col("n") > 0))
    often = sets.select(F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("df"))
    rarest = whole.select("s", F.explode("elements").alias("e")).join(often, "e").groupBy("s").agg(F.min(F.struct("df", "e"))["e"].alias("e"))
    small = rarest.join(whole, "s").select(F.col("s").alias("x"), "e", F.col("elements").alias("ex"), F.col("n").alias("nx"))
    large = sets.select(F.col("s").alias("y"), F.explode("elements").alias("_e"), F.col("elements").alias("ey"), F.col("n").alias("ny"))
    held = small.join(large, (F.col("e") == F.col("_e")) & (F.col("nx") < F.col("ny"))).filter(F.size(F.array_except("ex", "ey")) == 0)
    found = held.select("x", "y", F.col("nx").alias("shared")).unionByName(whole.select(F.col("s").alias("x"), F.col("s").alias("y"), F.col("n").alias("shared")))
    return expanded(of_key, found).select("a", "b", "shared")
