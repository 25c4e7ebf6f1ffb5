"""Registered queries of the time-series engine, with the SQL each is compared with."""

from . import decision_queries, price_queries, research_queries

QUERIES = {**price_queries.QUERIES, **research_queries.QUERIES, **decision_queries.QUERIES}
ORACLE_SQL = {**price_queries.SQL, **research_queries.SQL, **decision_queries.SQL}
