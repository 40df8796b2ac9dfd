"""All registered queries of the code-graph library."""

from graphloom.plans import contract_queries, export_queries, form_queries, graph_queries, provider_queries, repository_queries, request_queries, store_queries, text_queries  # noqa: F401
from graphloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
