"""All named queries. Importing the modules registers them."""

from __future__ import annotations

from . import history, modelling, planning, ingest, fitted  # noqa: F401
from .registry import ORACLES, QUERIES, RAW


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)


def raw_queries():
    """The queries without the rounding that comparison by value needs."""
    return dict(RAW)
