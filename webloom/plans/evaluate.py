"""A model's scores against a golden model, in one row, and the report by golden class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.store import stored


@dataclass
class Evaluation:
    summary: DataFrame  # weighted_f, purity, cohesion, links_recall
    matches: DataFrame  # golden class → its best computed class
    report: DataFrame  # a line for each golden class


def evaluate(pages: DataFrame, golden: DataFrame, golden_links: DataFrame, links: DataFrame) -> Evaluation:
    """``pages``: (class_id, url); ``golden``: (name, pattern); ``golden_links``: (src, link_type, dest) of golden names;
    ``links``: the same of computed classes, which are called by the golden class they match best.
    """
    # all scores read these two; they have rows by classes, not by pages
    sizes = stored(pages.groupBy("class_id").agg(F.count("*").alias("size")), "sizes")
    matrix = stored(E.count_matrix(E.golden_matches(pages, golden), sizes, golden), "matrix")
    best = E.best_matches(E.precision_recall(matrix, sizes))
    # one golden name a computed class: the one with the larger F, then the first
    names = best.filter("f > 0").groupBy("class_id").agg(F.max_by("golden", F.struct("f", "golden")).alias("golden"))
    a, b = names.select(F.col("class_id").alias("src"), F.col("golden").alias("src_name")), names.select(F.col("class_id").alias("dest"), F.col("golden").alias("dest_name"))
    named = links.join(a, "src").join(b, "dest").select(F.col("src_name").alias("src"), "link_type", F.col("dest_name").alias("dest"))
    recalls = E.link_recall(golden_links, named)
    summary = (
        E.weighted_f(best)
        .crossJoin(E.weighted_mean(E.purity(matrix, sizes), "purity"))
        .crossJoin(E.weighted_mean(E.cohesion(matrix, sizes), "entropy").withColumnRenamed("entropy", "cohesion"))
        .crossJoin(E.overall_link_recall(recalls))
    )  # fmt: skip - single rows
    return Evaluation(summary, best, E.report(best, recalls))
