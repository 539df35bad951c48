"""Declarative descriptions of panels and specifications, and staged runs."""

from .specs import PANEL, SPECIFICATIONS, PanelSpec, Specification

__all__ = ["PANEL", "SPECIFICATIONS", "PanelSpec", "Specification"]
