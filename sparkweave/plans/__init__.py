"""Domain views and the registered queries."""

from . import records, stored  # noqa: F401  they register their queries with the catalogue's
from .catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
