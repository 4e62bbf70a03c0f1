"""Continuous ingest and stateful replay."""
