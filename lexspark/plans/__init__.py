"""Queries over the test tables, each with an equivalent in SQL where that can be said."""
