"""Page and class schemas: link sampling, class labels, grouping by schema, splitting by labels, class names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links_to_fetch(links: DataFrame, keys: list[str], valid: Column, max_fetches: int = 3) -> DataFrame:
    """The links of a collection to fetch: all valid ones of a small collection, else the first valid, the next valid
    from the middle on, and the last valid after that. ``links`` has ``pos`` from 0; one aggregate finds all three.
    """
    rows = links.withColumn("_valid", valid)
    marks = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("_valid"), F.col("pos"))).alias("first"),
        F.max(F.when(F.col("_valid"), F.col("pos"))).alias("last"),
        F.array_sort(F.collect_set(F.when(F.col("_valid"), F.col("pos")))).alias("places"),
    )
    middle = F.array_min(F.filter("places", lambda p: (p >= F.floor((F.col("n") - 1) / 2)) & (p > F.col("first"))))
    second = marks.withColumn("middle", middle)
    third = F.when(F.col("last") > F.coalesce("middle", "first"), F.col("last"))
    picked = F.when(F.col("n") <= max_fetches, F.col("places")).otherwise(F.array_compact(F.array("first", "middle", third)))
    return second.select(*keys, F.explode(picked).alias("pos")).join(links, [*keys, "pos"])


def class_labels(labels: DataFrame) -> DataFrame:
    """(class_id, xpath) of paths that at least two pages of the class have, all with the same set of texts."""
    page = labels.groupBy("class_id", "page", "xpath").agg(F.array_sort(F.collect_set("label")).alias("texts"))
    return page.groupBy("class_id", "xpath").agg(F.count("*").alias("pages"), F.min("texts").alias("least"), F.max("texts").alias("most")).filter("pages >= 2 AND least = most").select("class_id", "xpath")


def page_schemas(links: DataFrame, *keys: str) -> DataFrame:
    return links.groupBy(*keys).agg(F.array_sort(F.collect_set("xpath")).alias("schema"))


def schema_groups(schemas: DataFrame, page: str = "page") -> DataFrame:
    """Pages with equal schemas share a group; groups are numbered by their first page. Adds group_id and group_size."""
    groups = schemas.groupBy("schema").agg(F.min(page).alias("first_page"), F.count("*").alias("group_size"))
    return schemas.join(groups, "schema").select(page, "schema", F.col("first_page").alias("group_id"), "group_size")


def label_split(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Split groups (page, group_id): pages with labels that lack one of their group's class labels go to a part of their own.

    Adds part: 0 for those that stay, 1 for those that leave.
    """
    own = labels.groupBy("page").agg(F.collect_set("xpath").alias("has"))
    wanted = class_labels(labels.join(assigned.select("page", F.col("group_id").alias("class_id")), "page")).groupBy(F.col("class_id").alias("group_id")).agg(F.collect_set("xpath").alias("needs"))
    rows = assigned.join(own, "page", "left").join(wanted, "group_id", "left")
    lacks = F.col("has").isNotNull() & F.col("needs").isNotNull() & (F.size(F.array_except("needs", "has")) > 0)
    return rows.select("page", "group_id", F.when(lacks, 1).otherwise(0).alias("part"))


def candidates(parts: DataFrame) -> DataFrame:
    """Candidate classes (site, group_id, part, size), the largest of each site first, by ``nth``."""
    sizes = parts.groupBy("site", "group_id", "part").agg(F.count("*").alias("size"))
    return sizes.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("size"), "group_id", "part")))


def class_schemas(links: DataFrame, labels: DataFrame) -> DataFrame:
    """class_id and schema: all link paths of its pages and its class labels. ``links``: (class_id, page, xpath)."""
    every = links.select("class_id", "xpath").union(class_labels(labels))
    return every.groupBy("class_id").agg(F.array_sort(F.collect_set("xpath")).alias("schema"))


def merge_classes(assignment: DataFrame, merges: DataFrame) -> DataFrame:
    """Assignment (class_id, page) after ``merges`` (from_id, to_id): pages change class, the smaller table is joined."""
    m = merges.select(F.col("from_id").alias("class_id"), "to_id")
    return assignment.join(m, "class_id", "left").select(F.coalesce("to_id", "class_id").alias("class_id"), "page")


def set_algebra(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Union, intersection and both differences of two array columns."""
    return pairs.withColumns({"union_size": F.size(F.array_union(a, b)), "common_size": F.size(F.array_intersect(a, b)), "only_a": F.size(F.array_except(a, b)), "only_b": F.size(F.array_except(b, a))})
