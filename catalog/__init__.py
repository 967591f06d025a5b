"""Registered queries with the SQL that checks them, by area."""

from catalog.base import ORACLES, QUERIES  # noqa: F401
from catalog import batches, evaluating, facts, features, models, profiling, quality, scoring, states  # noqa: F401
