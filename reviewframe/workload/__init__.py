"""Queries over the test tables, with the SQL that recomputes them by another route."""
