"""Dataflows over tables: ingest, search, notes, work lists, capture, evaluation."""
