"""The query catalog: importing the query modules registers every query."""

from stepjudge.plans import curation_queries, evaluation_queries, search_queries, table_queries, text_queries  # noqa: F401
from stepjudge.plans.registry import ORACLES, QUERIES  # noqa: F401
