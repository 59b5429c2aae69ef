"""All registered queries and their SQL."""

from __future__ import annotations

from shelfspark.plans import index_plans, page_plans, ranking_plans, record_plans, request_plans, search_plans, value_plans, word_plans

_MODULES = (page_plans, value_plans, record_plans, search_plans, ranking_plans, index_plans, word_plans, request_plans)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
