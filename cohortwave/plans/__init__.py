"""Queries over the supplied tables, each with its SQL counterpart."""
from . import cohort, events, spectral, cycles, stats, quality, models, representations  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
