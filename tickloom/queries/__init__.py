"""Registered queries of the market-event operators with their SQL twins."""

from tickloom.queries.market import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
