"""Scores of a model against a golden one: matches by URL pattern, precision, recall, F, purity, cohesion, link recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Patterns of a golden model that are broadcast; more are compared in pieces of about so many.
PATTERNS = 10_000


def small(df: DataFrame, most: int = PATTERNS) -> bool:
    """Whether the rows may be broadcast: their number is counted, up to the bound."""
    return df.limit(most + 1).count() <= most


def golden_matches(pages: DataFrame, golden: DataFrame) -> DataFrame:
    """(class_id, page, golden) for each golden class one of whose patterns matches the whole URL.

    ``golden``: (name, pattern). A model's worth of rows is broadcast, and the pages are read once; beyond ``PATTERNS`` each
    page meets one piece of the patterns after another.
    """
    matching = F.expr("url RLIKE concat('^(?:', pattern, ')$')")
    if small(golden):
        found = pages.join(F.broadcast(golden), matching)
    else:
        pieces = 1 + golden.count() // PATTERNS
        cut = golden.withColumn("piece", F.pmod(F.xxhash64("name", "pattern"), F.lit(pieces)).cast("int"))
        found = pages.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).join(cut, "piece").filter(matching)
    return found.select("class_id", F.col("url").alias("page"), F.col("name").alias("golden")).distinct()


def count_matrix(matches: DataFrame, classes: DataFrame, golden: DataFrame) -> DataFrame:
    """golden, class_id and the number of pages in both, for every pair (a model's classes by a golden model's)."""
    counts = matches.groupBy("golden", "class_id").agg(F.count("*").alias("n"))
    names = golden.select(F.col("name").alias("golden")).distinct()
    cells = classes.select("class_id").distinct().crossJoin(F.broadcast(names) if small(names) else names)
    return cells.join(counts, ["golden", "class_id"], "left").select("golden", "class_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def golden_sizes(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("golden").agg(F.sum("n").alias("size"))


def precision_recall(matrix: DataFrame, sizes: DataFrame) -> DataFrame:
    """Precision, recall and F of every cell; ``sizes``: (class_id, size). All are 0 where nothing is shared."""
    whole = F.sum("n").over(Window.partitionBy("golden"))
    rows = matrix.withColumn("golden_size", whole).join(sizes, "class_id")
    p, r = F.coalesce(F.try_divide("n", "size"), F.lit(0.0)), F.coalesce(F.try_divide("n", "golden_size"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rows.withColumns({"precision": p, "recall": r}).withColumn("f", f).select("golden", "class_id", "n", "size", "golden_size", "precision", "recall", "f")


def best_matches(scored: DataFrame) -> DataFrame:
    """Each golden class's match of the largest F, of the lowest class among equals."""
    rank = F.row_number().over(Window.partitionBy("golden").orderBy(F.desc("f"), "class_id"))
    return scored.withColumn("rank", rank).filter("rank = 1").drop("rank")


def weighted_f(best: DataFrame) -> DataFrame:
    return best.agg(F.coalesce(F.try_divide(F.sum(F.col("f") * F.col("golden_size")), F.sum("golden_size")), F.lit(0.0)).alias("weighted_f"))


def cohesion(matrix: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entropy of each computed class over the golden ones, for classes with a match."""
    rows = matrix.join(sizes, "class_id").filter("n > 0").withColumn("p", F.col("n") / F.col("size"))
    return rows.groupBy("class_id", "size").agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def purity(matrix: DataFrame, sizes: DataFrame) -> DataFrame:
    """Share of each computed class that its largest golden class has."""
    return matrix.groupBy("class_id").agg(F.max("n").alias("most")).join(sizes, "class_id").filter("most > 0").select("class_id", "size", (F.col("most") / F.col("size")).alias("purity"))


def weighted_mean(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col("size")), F.sum("size")), F.lit(0.0)).alias(value))


def link_recall(golden_links: DataFrame, computed: DataFrame) -> DataFrame:
    """Per golden class, the share of its links that a computed link of the same type and destination answers.

    Both sides: (src, link_type, dest); repeated links are matched one to one.
    """
    nth = F.row_number().over(Window.partitionBy("src", "link_type", "dest").orderBy(F.lit(1)))
    g, c = golden_links.select("src", "link_type", "dest").withColumn("nth", nth), computed.select("src", "link_type", "dest").withColumn("nth", nth)
    hit = g.join(c.withColumn("hit", F.lit(1)), ["src", "link_type", "dest", "nth"], "left")
    return hit.groupBy("src").agg(F.count("*").alias("links"), F.coalesce(F.sum("hit"), F.lit(0)).alias("matched")).withColumn("links_recall", F.col("matched") / F.col("links"))


def overall_link_recall(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.coalesce(F.try_divide(F.sum("matched"), F.sum("links")), F.lit(0.0)).alias("links_recall"))


def report(best: DataFrame, recalls: DataFrame) -> DataFrame:
    """A line for each golden class: match, precision, recall, F and link recall with two digits (half even), ``-`` for none."""
    two = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(F.bround(c, 2).cast("string"), "(\\.[0-9]*?)0+$", "$1"), "\\.$", ""), F.lit("-"))
    rows = best.join(recalls.select(F.col("src").alias("golden"), "links_recall"), "golden", "left")
    return rows.select("golden", F.concat_ws("\t", "golden", "class_id", two(F.col("precision")), two(F.col("recall")), two(F.col("f")), two(F.col("links_recall"))).alias("line"))
