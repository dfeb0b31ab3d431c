"""The frontier of a crawl: priority, deduplication, budgets, retries, politeness, spill, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.store import stored

#: Priority of a URL: depth of its class, class name, site, address, form parameters.
PRIORITY = ("depth", "class_name", "site", "url", "form_params")


def _order(columns: tuple[str, ...] = PRIORITY) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def by_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``piece``: a site's rows in that order are cut into pieces, wherever the ranges of all rows end.

    A running sum over a site is then one within its pieces and one over a row a piece, so a large site is no single task.
    """
    ranged = rows.repartitionByRange(F.col("site"), *[F.col(c).asc_nulls_first() for c in order])
    return stored(ranged.withColumn("piece", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a site up to this one; ``order`` tells rows of a site apart."""
    ranged = by_ranges(rows.withColumn("_value", value), *order)
    pieces = ranged.groupBy("site", "piece").agg(F.sum("_value").alias("_all"))
    before = Window.partitionBy("site").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("site", "piece", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("site", "piece").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(pieces, ["site", "piece"]).withColumn(name, F.col("_before") + F.sum("_value").over(upto)).drop("_value", "_before", "piece")


def densest_first(collections: DataFrame) -> DataFrame:
    """Collections in order of exploration: those of classes with one page first, then by links per distinct URL of the class.

    Needs class_size, n_links, out_urls, page, xpath; adds nth from 1.
    """
    ratio = F.try_divide(F.col("n_links").cast("double"), F.col("out_urls").cast("double"))
    order = [F.desc(F.col("class_size") == 1), F.desc(ratio), F.asc("page"), F.asc("xpath")]
    return collections.withColumn("ratio", ratio).withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy(*order)))


def top_k(frontier: DataFrame, k: int) -> DataFrame:
    """The next k URLs overall; a top-k per task and one merge, no full sort."""
    return frontier.orderBy(*_order()).limit(k)


def top_k_by_site(frontier: DataFrame, k: int, *ties: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("site").orderBy(*_order((*PRIORITY, *ties))))
    return frontier.withColumn("nth", nth).filter(F.col("nth") <= k)


def dedupe(new: DataFrame, visited: DataFrame) -> DataFrame:
    """New URLs whose key hasn't been seen: one URL a (site, key), the first by priority, and none of the visited keys."""
    keyed = new.withColumn("key", urls.checksum(urls.relative_key(F.col("url"), F.col("form_params"))))
    first = keyed.groupBy("site", "key").agg(F.min(F.struct(*[F.col(c) for c in PRIORITY])).alias("first"))
    fresh = first.join(visited.select("site", "key").distinct(), ["site", "key"], "left_anti")
    return fresh.select("key", "first.*")


def spill(frontier: DataFrame, capacity: int, *ties: str) -> DataFrame:
    """Marks the URLs that a memory of ``capacity`` a site holds; the rest keep their full address and their place.

    ``ties``: columns that order rows of one address, where a frontier has such; without them their order is open.
    """
    ranked = running(frontier, F.lit(1), [*(c for c in PRIORITY if c != "site"), *ties], "nth").withColumn("nth", F.col("nth").cast("int"))
    return ranked.withColumn("in_memory", F.col("nth") <= capacity)


def page_budget(fetches: DataFrame, budget: int) -> DataFrame:
    """The fetches of each site that its budget allows, in order of ``nth``."""
    used = F.row_number().over(Window.partitionBy("site").orderBy("nth", "url"))
    return fetches.withColumn("used", used).filter(F.col("used") <= budget)


def retries(attempts: DataFrame, max_failures: int) -> DataFrame:
    """State of each URL after its attempts (url, code): done, retry while failures are at most ``max_failures`` (so that one more attempt may follow), or dropped."""
    totals = attempts.groupBy("url").agg(F.count_if(F.col("code") != 0).alias("failures"), F.count_if(F.col("code") == 0).alias("successes"))
    state = F.when(F.col("successes") > 0, "done").when(F.col("failures") <= max_failures, "retry").otherwise("dropped")
    return totals.withColumn("state", state)


def politeness(fetches: DataFrame, seed: int = 0) -> DataFrame:
    """When each fetch of a site may start: the sum of waits before it, each a fixed wait and a pause drawn from the URL's hash.

    Needs site, url, nth, wait_ms, random_pause_ms; no pause if that is 0.
    """
    draw = F.pmod(F.conv(F.substring(F.sha1(F.concat(F.col("url"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.greatest(F.col("random_pause_ms"), F.lit(1)))
    rows = fetches.withColumn("delay_ms", F.col("wait_ms") + F.when(F.col("random_pause_ms") > 0, draw).otherwise(0))
    return running(rows, F.col("delay_ms"), ["nth", "url"], "scheduled_ms")


def recover(events: DataFrame) -> DataFrame:
    """The frontier that a log of events (seq, site, url, event: stored, next, completed) leaves: stored and not completed.

    A URL taken but not completed is in process and comes back, so a page may be fetched twice, never lost.
    """
    state = events.groupBy("site", "url").agg(F.max(F.when(F.col("event") == "completed", 1).otherwise(0)).alias("completed"), F.max(F.when(F.col("event") == "next", 1).otherwise(0)).alias("taken"), F.min("seq").alias("first_seq"))
    return state.filter("completed = 0").select("site", "url", "first_seq", (F.col("taken") == 1).alias("in_process"))
