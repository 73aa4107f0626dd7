"""Registered queries with their SQL oracles, and computed fields."""

from tessera.plans import registry, workflow_queries  # noqa: F401  (each module adds its queries to the registry's)
from tessera.plans import analytics_queries, check_queries, code_queries, expression_queries, graph_queries, lookup_queries, rule_queries, state_queries, tree_queries  # noqa: F401
