"""All queries of the core; importing the modules registers them."""

from pinloom.plans import queries_analysis, queries_catalog, queries_gates, queries_graph, queries_records, queries_search, queries_sources  # noqa: F401
from pinloom.plans.registry import QUERIES, SQL  # noqa: F401
