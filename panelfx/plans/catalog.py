"""All registered queries."""

from . import design_queries, effect_queries, panel_queries  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
