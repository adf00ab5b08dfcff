"""The queries the package registers."""

from __future__ import annotations

from importlib import import_module

# one module per area; importing it registers its queries
AREAS = ["feature_queries", "score_queries", "graph_queries", "explain_queries", "model_queries"]


def all_queries():
    from .registry import REGISTRY

    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return REGISTRY
