"""See the README for what lives here."""

from tessera.jobs import evidence_queries, record_queries  # noqa: F401  register their queries
from tessera.jobs.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
