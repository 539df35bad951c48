"""Operators bound to the driver tables, each next to its SQL counterpart."""

from . import checks, estimation, links, panels, reports, texts  # noqa: F401  (registration)
from .registry import oracles, registered

__all__ = ["oracles", "registered"]
