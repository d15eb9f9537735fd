"""Continuous ingest and import."""
