"""Structured Streaming counterparts of the telemetry operators."""
