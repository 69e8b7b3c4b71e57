"""Domain mapping of the warehouse tables and the registered queries."""


def load_all():
    """Import every query module so the registry is complete."""
    from . import (cluster_queries, growth_queries, lift_queries,  # noqa: F401
                   match_queries, opportunity_queries, table_queries)
    from .registry import REGISTRY
    return REGISTRY
