"""Registered queries, and DuckDB SQL over the same tables for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the SQL: links of pages, with the host as class, and what is made of them.
PARTS = {
    "links": r"""links AS (SELECT page_id, url, CAST(unnest(range(len(hs))) AS INTEGER) AS pos, unnest(hs) AS href
      FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages))""",
    "hosts": r"""hosts AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host,
      regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root FROM pages)""",
    "occ": r"""occ AS (SELECT DISTINCT h.host AS class_id, l.page_id AS page, l.href AS xpath FROM links l JOIN hosts h USING (page_id))""",
    "urls_n": r"""urls_n AS (SELECT page, count(*) AS n FROM occ GROUP BY page)""",
    "idf": r"""idf AS (SELECT xpath, ln((SELECT count(DISTINCT page) FROM occ) / count(DISTINCT page)::DOUBLE) AS idf FROM occ GROUP BY xpath)""",
    "size": r"""size AS (SELECT class_id, count(DISTINCT page) AS size FROM occ GROUP BY class_id)""",
    "tfidf": r"""tfidf AS (SELECT o.class_id, o.xpath, count(DISTINCT page)::DOUBLE / any_value(s.size) * any_value(i.idf) AS tfidf
      FROM occ o JOIN size s USING (class_id) JOIN idf i USING (xpath) GROUP BY o.class_id, o.xpath)""",
    "members": r"""members AS (SELECT DISTINCT class_id, xpath FROM occ)""",
    "member_n": r"""member_n AS (SELECT class_id, count(*) AS n FROM members GROUP BY class_id)""",
    "pairs": r"""pairs AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared FROM members x JOIN members y ON x.xpath = y.xpath AND x.class_id < y.class_id GROUP BY 1, 2)""",
    "page_cost": r"""page_cost AS (SELECT p.class_id, p.page, sum(CASE WHEN o.xpath IS NULL THEN 1.0 ELSE 0.8 END / (t.tfidf + 1)) + any_value(u.n) AS cost
      FROM (SELECT DISTINCT class_id, page FROM occ) p JOIN tfidf t USING (class_id) LEFT JOIN occ o ON o.page = p.page AND o.xpath = t.xpath JOIN urls_n u ON u.page = p.page GROUP BY 1, 2)""",
    "class_cost": r"""class_cost AS (SELECT class_id, own + pages AS cost FROM (SELECT class_id, sum(1 / (tfidf + 1)) AS own FROM tfidf GROUP BY 1)
      JOIN (SELECT class_id, sum(cost) AS pages FROM page_cost GROUP BY 1) USING (class_id))""",
    "golden": r"""golden(name, pattern) AS (VALUES ('english', 'https?://[^/]*/en/.*'), ('french', 'https?://[^/]*/fr/.*'), ('german', 'https?://[^/]*/de/.*'), ('spanish', 'https?://[^/]*/es/.*'), ('top', '.*#top'))""",
    "matches": r"""matches AS (SELECT DISTINCT h.host AS class_id, h.url AS page, g.name AS golden FROM hosts h JOIN golden g ON regexp_full_match(h.url, g.pattern))""",
    "sizes": r"""sizes AS (SELECT host AS class_id, count(*) AS size FROM hosts GROUP BY 1)""",
    "matrix": r"""matrix AS (SELECT g.name AS golden, s.class_id, count(m.page) AS n FROM (SELECT DISTINCT name FROM golden) g CROSS JOIN sizes s
      LEFT JOIN matches m ON m.golden = g.name AND m.class_id = s.class_id GROUP BY 1, 2)""",
    "scored": r"""scored AS (SELECT golden, class_id, n, size, golden_size, precision, recall, CASE WHEN n = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f
      FROM (SELECT m.golden, m.class_id, m.n, s.size, g.golden_size, n / s.size::DOUBLE AS precision, CASE WHEN n = 0 THEN 0.0 ELSE n / g.golden_size::DOUBLE END AS recall
      FROM matrix m JOIN sizes s USING (class_id) JOIN (SELECT golden, CAST(sum(n) AS BIGINT) AS golden_size FROM matrix GROUP BY 1) g USING (golden)))""",
    "best": r"""best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY golden ORDER BY f DESC, class_id) AS r FROM scored) WHERE r = 1)""",
    "class_links": r"""class_links AS (SELECT h.host AS src, '/nav/' || (l.pos % 3) AS xpath, CASE l.pos % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'menu' ELSE 'singleton' END AS link_type,
      CASE WHEN l.pos % 3 = 2 THEN left(l.href, 3) END AS anchor_text, 'c' || (length(l.href) % 7) AS dest, l.page_id, l.pos, l.href FROM links l JOIN hosts h USING (page_id))""",
}


def sql(body: str, *parts: str) -> str:
    return ("WITH RECURSIVE " + ",\n".join(PARTS[p] for p in parts) + "\n" if parts else "") + body


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register
