"""Distances, costs and evaluation. Classes are hosts, paths are hrefs, golden classes are patterns on URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import evaluation as E
from ..operators import schemas as S
from ..operators import scoring as C
from ..sources import pages as P
from .registry import query, sql

#: Pattern of each golden class.
GOLDEN = (("english", "https?://[^/]*/en/.*"), ("french", "https?://[^/]*/fr/.*"), ("german", "https?://[^/]*/de/.*"), ("spanish", "https?://[^/]*/es/.*"), ("top", ".*#top"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.anchors(P.read_pages(spark, sf_dir))
    return rows.select(urls.host(F.col("url")).alias("class_id"), F.col("page_id").alias("page"), F.col("href").alias("xpath")).distinct()


def page_urls(occ: DataFrame) -> DataFrame:
    return occ.groupBy("page").agg(F.count("*").alias("n"))


def r9(c: str) -> object:
    return F.round(c, 9).alias(c)


BASE = ("links", "hosts", "occ")
WEIGHTS = (*BASE, "idf", "size", "tfidf")
PAIRS = (*BASE, "members", "member_n", "pairs")


@query(sql("SELECT xpath, round(idf, 9) AS idf FROM idf", *BASE, "idf"))
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.idf(occurrences(spark, sf_dir)).select("xpath", r9("idf"))


@query(sql("SELECT class_id, xpath, round(tfidf, 9) AS tfidf FROM tfidf", *WEIGHTS))
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tfidf(occurrences(spark, sf_dir)).select("class_id", "xpath", r9("tfidf"))


@query(sql("SELECT class_id, page, round(cost, 6) AS cost FROM page_cost", *WEIGHTS, "urls_n", "page_cost"))
def page_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = occurrences(spark, sf_dir)
    return C.page_costs(occ, page_urls(occ)).select("class_id", "page", F.round("cost", 6).alias("cost"))


@query(sql("SELECT class_id, round(cost, 6) AS cost FROM class_cost", *WEIGHTS, "urls_n", "page_cost", "class_cost"))
def class_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = occurrences(spark, sf_dir)
    return C.class_costs(occ, page_urls(occ)).select("class_id", F.round("cost", 6).alias("cost"))


@query(sql("SELECT round(sum(cost), 4) AS cost FROM class_cost", *WEIGHTS, "urls_n", "page_cost", "class_cost"))
def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = occurrences(spark, sf_dir)
    return C.model_cost(occ, page_urls(occ)).select(F.round("cost", 4).alias("cost"))


@query(sql(r"""SELECT a, b, round(joint - ca.cost - cb.cost, 6) AS delta FROM (
    SELECT m.a, m.b, sum(price) + sum(lack) + any_value(urls) AS joint FROM (
      SELECT p.a, p.b, w.xpath, 1 / (w.tfidf + 1) AS price, (w.pages - w.n + 0.8 * w.n) / (w.tfidf + 1) AS lack, w.urls FROM pairs p, LATERAL (
        SELECT o.xpath, count(*) AS n, any_value(i.idf) * count(*) / any_value(s.pages) AS tfidf, any_value(s.pages) AS pages, any_value(s.urls) AS urls
        FROM occ o JOIN idf i USING (xpath), (SELECT count(DISTINCT page)::DOUBLE AS pages, count(*) AS urls FROM occ WHERE class_id IN (p.a, p.b)) s
        WHERE o.class_id IN (p.a, p.b) GROUP BY o.xpath) w) m GROUP BY 1, 2) j
  JOIN class_cost ca ON ca.class_id = a JOIN class_cost cb ON cb.class_id = b""", *WEIGHTS, "urls_n", "page_cost", "class_cost", "members", "pairs"))
def merge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = occurrences(spark, sf_dir)
    pairs = C.pair_overlaps(occ, "class_id", "xpath")
    return C.merge_deltas(occ, page_urls(occ), pairs).select("a", "b", F.round("delta", 6).alias("delta"))


DISTANCE = "SELECT a, b, shared, round((x.n + y.n - 2 * shared) / (x.n + y.n - shared)::DOUBLE, 9) AS distance FROM pairs JOIN member_n x ON x.class_id = a JOIN member_n y ON y.class_id = b"


@query(sql(DISTANCE, *PAIRS))
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.jaccard_pairs(occurrences(spark, sf_dir), "class_id", "xpath").select("a", "b", "shared", r9("distance"))


LETTERS = """let AS (SELECT DISTINCT page_id AS class_id, left(href, 2) AS xpath FROM links), let_n AS (SELECT class_id, count(*) AS n FROM let GROUP BY 1),
  let_p AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared FROM let x JOIN let y ON x.xpath = y.xpath AND x.class_id < y.class_id GROUP BY 1, 2)"""


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.anchors(P.read_pages(spark, sf_dir)).select(F.col("page_id").alias("class_id"), F.substring("href", 1, 2).alias("xpath"))


@query(sql("SELECT 1", "links").replace("\nSELECT 1", ",\n" + LETTERS + "\nSELECT * FROM (SELECT a, b, shared, round((x.n + y.n - 2 * shared) / (x.n + y.n - shared)::DOUBLE, 9) AS distance FROM let_p JOIN let_n x ON x.class_id = a JOIN let_n y ON y.class_id = b) WHERE distance < 0.2"))
def collapse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse_pairs(letters(spark, sf_dir), "class_id", "xpath").select("a", "b", "shared", r9("distance"))


@query(sql("SELECT 1", "links").replace("\nSELECT 1", ",\n" + LETTERS + "\nSELECT a, b, shared FROM let_p JOIN let_n x ON x.class_id = a JOIN let_n y ON y.class_id = b WHERE shared = least(x.n, y.n)"))
def subset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.subset_pairs(letters(spark, sf_dir), "class_id", "xpath").select("a", "b", "shared")


@query(sql("""SELECT a, b, round(diff / (diff + inter), 9) AS distance FROM (SELECT p.a, p.b, x.w + y.w - p.inter AS diff, p.inter FROM
    (SELECT s.class_id AS a, t.class_id AS b, sum(2 + s.tfidf + t.tfidf) AS inter FROM tfidf s JOIN tfidf t ON s.xpath = t.xpath AND s.class_id < t.class_id GROUP BY 1, 2) p
    JOIN (SELECT class_id, sum(1 + tfidf) AS w FROM tfidf GROUP BY 1) x ON x.class_id = a JOIN (SELECT class_id, sum(1 + tfidf) AS w FROM tfidf GROUP BY 1) y ON y.class_id = b)""", *WEIGHTS))
def weighted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.weighted_distance(C.tfidf(occurrences(spark, sf_dir))).select("a", "b", r9("distance"))


@query(sql("""SELECT a, b, round((x.n + y.n - 2 * shared) / (x.n + y.n - shared)::DOUBLE, 9) AS distance FROM (
    SELECT x.c AS a, y.c AS b, count(*) AS shared FROM el x JOIN el y ON x.e = y.e AND x.c < y.c GROUP BY 1, 2) JOIN el_n x ON x.c = a JOIN el_n y ON y.c = b""", "links", "hosts", "class_links").replace("\nSELECT a, b", """,
  el AS (SELECT DISTINCT src AS c, xpath || chr(9) || link_type AS e FROM class_links UNION SELECT DISTINCT dest, xpath || chr(9) || link_type FROM class_links), el_n AS (SELECT c, count(*) AS n FROM el GROUP BY 1)
SELECT a, b"""))
def link_graph_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_queries import class_links

    members = C.link_graph_elements(class_links(spark, sf_dir))
    return C.jaccard_pairs(members, "class_name", "element").select("a", "b", r9("distance"))


@query(sql("""SELECT p.a, p.b, len(list_distinct(list_concat(x.s, y.s)))::INTEGER AS union_size, len(list_intersect(x.s, y.s))::INTEGER AS common_size,
    len(list_filter(x.s, lambda e: NOT list_contains(y.s, e)))::INTEGER AS only_a, len(list_filter(y.s, lambda e: NOT list_contains(x.s, e)))::INTEGER AS only_b
  FROM pairs p JOIN (SELECT class_id, list(xpath) AS s FROM members GROUP BY 1) x ON x.class_id = a JOIN (SELECT class_id, list(xpath) AS s FROM members GROUP BY 1) y ON y.class_id = b""", *PAIRS))
def schema_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = occurrences(spark, sf_dir)
    sets = occ.groupBy("class_id").agg(F.collect_set("xpath").alias("s"))
    pairs = C.pair_overlaps(occ, "class_id", "xpath").select("a", "b")
    rows = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("s").alias("y")), "b")
    return S.set_algebra(rows, "x", "y").select("a", "b", "union_size", "common_size", "only_a", "only_b")


@query(sql("SELECT coalesce(CASE WHEN page_id % 4 = 0 THEN 'merged' END, host) AS class_id, count(*) AS pages FROM (SELECT page_id, host, min(page_id) OVER (PARTITION BY host) AS page_id_ FROM hosts) WHERE true GROUP BY 1", "hosts").replace("page_id % 4 = 0", "page_id_ % 4 = 0"))
def class_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.read_pages(spark, sf_dir).select(urls.host(F.col("url")).alias("class_id"), F.col("page_id").alias("page"))
    merges = rows.groupBy(F.col("class_id").alias("from_id")).agg(F.min("page").alias("first")).filter("first % 4 = 0").select("from_id", F.lit("merged").alias("to_id"))
    return S.merge_classes(rows, merges).groupBy("class_id").agg(F.count("*").alias("pages"))


# ---- evaluation ----

EVAL = ("hosts", "golden", "matches", "sizes", "matrix")
SCORED = (*EVAL, "scored")


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """matrix, class sizes, golden classes."""
    pages = P.read_pages(spark, sf_dir).select(urls.host(F.col("url")).alias("class_id"), "url")
    golden = spark.createDataFrame(GOLDEN, "name string, pattern string")
    sizes = pages.groupBy("class_id").agg(F.count("*").alias("size"))
    return E.count_matrix(E.golden_matches(pages, golden), sizes, golden), sizes, golden


@query(sql("SELECT golden, class_id, n FROM matrix", *EVAL))
def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs(spark, sf_dir)[0]


@query(sql("SELECT golden, CAST(sum(n) AS BIGINT) AS size FROM matrix GROUP BY 1", *EVAL))
def golden_class_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.golden_sizes(inputs(spark, sf_dir)[0])


@query(sql("SELECT golden, class_id, n, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f, 9) AS f FROM scored", *SCORED))
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, sizes, _ = inputs(spark, sf_dir)
    return E.precision_recall(matrix, sizes).select("golden", "class_id", "n", r9("precision"), r9("recall"), r9("f"))


@query(sql("SELECT golden, class_id, round(f, 9) AS f FROM best", *SCORED, "best"))
def best_match_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, sizes, _ = inputs(spark, sf_dir)
    return E.best_matches(E.precision_recall(matrix, sizes)).select("golden", "class_id", r9("f"))


@query(sql("SELECT round(sum(f * golden_size) / sum(golden_size), 9) AS weighted_f FROM best", *SCORED, "best"))
def weighted_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, sizes, _ = inputs(spark, sf_dir)
    return E.weighted_f(E.best_matches(E.precision_recall(matrix, sizes))).select(r9("weighted_f"))


@query(sql("SELECT class_id, round(-sum(n / size::DOUBLE * ln(n / size::DOUBLE)), 9) + 0.0 AS entropy FROM matrix JOIN sizes USING (class_id) WHERE n > 0 GROUP BY 1", *EVAL))
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, sizes, _ = inputs(spark, sf_dir)
    return E.cohesion(matrix, sizes).select("class_id", (F.round("entropy", 9) + 0.0).alias("entropy"))


@query(sql("SELECT class_id, round(max(n) / any_value(size)::DOUBLE, 9) AS purity FROM matrix JOIN sizes USING (class_id) GROUP BY 1 HAVING max(n) > 0", *EVAL))
def purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, sizes, _ = inputs(spark, sf_dir)
    return E.purity(matrix, sizes).select("class_id", r9("purity"))


@query(sql("""SELECT (SELECT round(sum(e * size) / sum(size), 9) FROM (SELECT any_value(size) AS size, -sum(n / size::DOUBLE * ln(n / size::DOUBLE)) AS e FROM matrix JOIN sizes USING (class_id) WHERE n > 0 GROUP BY class_id)) AS entropy,
  (SELECT round(sum(m) / sum(size)::DOUBLE, 9) FROM (SELECT max(n) AS m, any_value(size) AS size FROM matrix JOIN sizes USING (class_id) GROUP BY class_id HAVING max(n) > 0)) AS purity""", *EVAL))
def weighted_cohesion_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, sizes, _ = inputs(spark, sf_dir)
    return E.weighted_mean(E.cohesion(matrix, sizes), "entropy").crossJoin(E.weighted_mean(E.purity(matrix, sizes), "purity")).select(r9("entropy"), r9("purity"))


LINK_SIDES = """g AS (SELECT src, link_type, dest, row_number() OVER (PARTITION BY src, link_type, dest) AS nth FROM class_links),
  c AS (SELECT src, link_type, dest, row_number() OVER (PARTITION BY src, link_type, dest) AS nth FROM (SELECT src, link_type, CASE WHEN pos < 2 THEN 'moved' ELSE dest END AS dest FROM class_links)),
  rec AS (SELECT src, count(*) AS links, count(c.nth) AS matched, count(c.nth) / count(*)::DOUBLE AS links_recall FROM g LEFT JOIN c USING (src, link_type, dest, nth) GROUP BY src)"""


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_queries import class_links

    rows = class_links(spark, sf_dir)
    return E.link_recall(rows, rows.withColumn("dest", F.when(F.col("pos") < 2, "moved").otherwise(F.col("dest"))))


@query(sql("SELECT 1", "links", "hosts", "class_links").replace("\nSELECT 1", ",\n" + LINK_SIDES + "\nSELECT src, links, matched, round(links_recall, 9) AS links_recall FROM rec"))
def link_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recalls(spark, sf_dir).select("src", "links", "matched", r9("links_recall"))


@query(sql("SELECT 1", "links", "hosts", "class_links").replace("\nSELECT 1", ",\n" + LINK_SIDES + "\nSELECT round(sum(matched) / sum(links)::DOUBLE, 9) AS links_recall FROM rec"))
def overall_link_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overall_link_recall(recalls(spark, sf_dir)).select(r9("links_recall"))


TWO = r"regexp_replace(regexp_replace(CAST(round_even({}, 2) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


# the golden classes have no links of their own here, so the last column is a dash
@query(sql(f"SELECT golden, concat_ws(chr(9), golden, class_id, {TWO.format('precision')}, {TWO.format('recall')}, {TWO.format('f')}, '-') AS line FROM best", *EVAL, "scored", "best"))
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, sizes, _ = inputs(spark, sf_dir)
    best = E.best_matches(E.precision_recall(matrix, sizes))
    return E.report(best, recalls(spark, sf_dir))
