"""All registered queries and their SQL."""

from . import annotated, files, flagship, genomics, learned, more, regions, relational, scanned, sequences  # noqa: F401  registration
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
