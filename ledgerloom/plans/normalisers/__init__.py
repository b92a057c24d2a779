"""Source rows to record domains: one small transform per source, found by name."""

from . import activity, payments, people, settings, webfiles  # noqa: F401  (they register)
from .base import REGISTRY, FrameSources, LandedSources, Normaliser, Sources

__all__ = ["REGISTRY", "FrameSources", "LandedSources", "Normaliser", "Sources"]
