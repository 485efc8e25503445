"""Ingestion jobs and sinks."""
