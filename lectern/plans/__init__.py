"""Queries over the supplied tables: what they run, and SQL that gives the same rows."""
