"""Column functions used across the engine."""

from ..operators.scoring import sigmoid
from ..operators.stats import normalized, stat_key

__all__ = ["normalized", "sigmoid", "stat_key"]
