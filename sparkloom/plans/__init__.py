"""Relational queries over registered tables."""
