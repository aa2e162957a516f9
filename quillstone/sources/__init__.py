"""Readers of files and records, and connectors to models."""
