"""All core queries by name, and their SQL."""

from . import evaluation, features, files, tables, text  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
