"""All queries of the engine. Importing it registers them."""

from __future__ import annotations

from . import (  # noqa: F401
    aggregates,
    extras,
    graphs_traces,
    intervals_spatial,
    overlays,
    relational,
    scalars,
    similarity,
    sources,
    streets,
    units,
)
from .registry import ORACLES, QUERIES, ROWS  # noqa: F401
