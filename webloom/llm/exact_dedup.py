"""Operator 4: exact deduplication by a 128-bit content hash, with the bytes compared inside groups.

Two texts are equal when they are the same after white space is deleted. Rows are grouped by the 128-bit hash of that
text together with the text itself, so Spark compares bytes inside each hash group and a collision makes two groups,
not one. Copies are merged on the map side first: a group of any size reaches the shuffle as a row for each task.
Each row finds its group again by the hash and the SHA-256 of the text.

Defined cases: null text counts as empty, and empty texts are equal; of equal texts the one with the most code points,
then the smallest doc_id stays (a null doc_id comes after all others); rows repeated with the same doc_id all
belong to the group and are kept or dropped alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole_text

#: The characters that equality ignores.
SPACE = " \t\n\x0b\x0c\r"


def without_space(text: Column) -> Column:
    """Six plain replacements; they search bytes, where translate would look up every character."""
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. ``hashed`` may be weakened to test collisions."""
    plain = without_space(F.col("text"))
    rows = whole_text(docs).select("doc_id", plain.alias("plain"), F.length("text").alias("n"))
    keyed = rows.withColumn("h", hashed(F.col("plain")))
    best = F.max(F.struct(F.col("n"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus_id")))
    groups = (
        keyed.groupBy("h", "plain").agg(F.count("*").alias("group_size"), best.alias("best"))
        .select("h", F.sha2("plain", 256).alias("text_sha256"), "group_size", (-F.col("best.minus_id")).alias("keep_id"))
    )
    members = keyed.select("doc_id", "h", F.sha2("plain", 256).alias("text_sha256"))
    return members.join(groups, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, one for each text, with all columns of ``docs``; of rows repeated as a whole one stays."""
    # ids as text, an empty one for null: the join and the ranking then need one and the same distribution of the rows
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    stay = exact_dedup(docs).filter("kept").select(name.alias("_row_id"), F.col("text_sha256").alias("_row_sha"))
    keyed = docs.withColumns({"_row_id": name, "_row_sha": F.sha2(without_space(F.coalesce("text", F.lit(""))), 256)})
    # the longest original of a doc_id that occurs with several texts of one class
    order = Window.partitionBy("_row_id", "_row_sha").orderBy(F.length(F.coalesce("text", F.lit(""))).desc())
    return keyed.join(stay, ["_row_id", "_row_sha"], "left_semi").withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents
), g AS (
  SELECT plain, count(*) AS group_size, first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id FROM t GROUP BY plain
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.plain) AS text_sha256 FROM t JOIN g USING (plain)
"""
