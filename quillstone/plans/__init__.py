"""Queries over the standard tables and their SQL."""
