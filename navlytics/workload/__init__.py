"""Queries over the given tables, each with its ANSI SQL twin where one exists."""
