"""Registered queries over the shared test tables and their SQL counterparts."""

from . import models, months, rows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
