"""Structured Streaming counterparts of ingestion, counting and telemetry."""
