"""Registered queries over the driver tables, with their SQL twins."""

from ledgerveil.catalog import (  # noqa: F401
    evaluation,
    explanation,
    knowledge,
    loading,
    modelling,
    privacy,
    quality,
    robust,
    splitting,
    streams,
)
from ledgerveil.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
