"""Panel causal-effect estimation as Spark jobs."""

from .spec import PanelSpec

__all__ = ["PanelSpec"]
