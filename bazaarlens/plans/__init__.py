"""Queries over the supplied tables and the SQL they are checked against."""

from bazaarlens.plans import catalog_queries, deal_queries, page_queries, price_queries, resolver_queries, review_queries, text_queries  # noqa: F401
from bazaarlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
