"""Registered queries with their SQL counterparts."""

from . import (  # noqa: F401  (importing a module registers its queries)
    health_queries,
    model_queries,
    pattern_queries,
    profile_queries,
    significance_queries,
    source_queries,
    suggestion_queries,
    transform_queries,
)
from .relations import REGISTRY

__all__ = ["REGISTRY"]
