"""Queries over the supplied tables, by theme; each module has QUERIES and ORACLE."""
