"""Binding views and the registry of queries."""

from . import blocks, changes, discovery, extraction, outputs, profiles, registry, streams  # noqa: F401
