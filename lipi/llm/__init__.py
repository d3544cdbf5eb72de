"""Operators of a training-data pipeline. Nothing else in the library
imports this subpackage."""

from .queries import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
