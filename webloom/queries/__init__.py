"""Queries over the tables, one or more for each operator."""

from . import crawl_queries, graph_queries, page_queries, score_queries, url_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "crawl_queries", "graph_queries", "page_queries", "score_queries", "url_queries"]
