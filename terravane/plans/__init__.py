"""Queries over the canonical tables; importing this package registers them."""

from . import coast, dynamics, grids, more, motion, reports, scenarios, shapes, spectral, stacks, streams, tables, zonal
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "coast", "dynamics", "grids", "more", "motion", "reports", "scenarios", "shapes", "spectral", "stacks", "streams", "tables", "zonal"]
