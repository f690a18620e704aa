"""Metrolith: a DataFrame-first analytics engine for places, networks and traces."""

__version__ = "0.1.0"
