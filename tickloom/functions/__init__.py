"""The function library: Column builders for batch plans, and bar-by-bar rules for folds and streams."""

from tickloom.functions import cumulative, recursive, scalar, window  # noqa: F401  (they register themselves)
from tickloom.functions.registry import REGISTRY, register  # noqa: F401
