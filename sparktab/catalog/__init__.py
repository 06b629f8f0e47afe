"""The registered queries."""

from . import checks, learning, preparation, shaping, training  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
