"""Registered queries and their SQL."""

from . import cube, explain, masks, samples, scores, spatial, tables
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cube", "explain", "masks", "samples", "scores", "spatial", "tables"]
