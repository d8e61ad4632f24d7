"""Registered queries: each pairs a Spark query with equivalent SQL."""

from catalog.core import ENTRIES, Entry
from catalog import dashboards, detection, revisions, rules_checks, text_features, workflows  # noqa: F401

__all__ = ["ENTRIES", "Entry"]
