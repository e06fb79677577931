"""All bound queries, gathered by importing the modules that register them."""

from . import (  # noqa: F401
    cluster_queries,
    conformity_queries,
    design_queries,
    flow_queries,
    lexical_queries,
    model_queries,
    source_queries,
    summary_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
