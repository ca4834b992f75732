"""Registers every module of queries in the catalogue."""

from barloom.plans import books, catalog, checks, lifetimes, reads, rule_tables, storage, streams  # noqa: F401

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
