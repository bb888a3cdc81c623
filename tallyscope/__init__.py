"""Audit analytics over ledgers, documents, findings and event streams on Spark."""

from tallyscope.session import get_session

__all__ = ["get_session"]
