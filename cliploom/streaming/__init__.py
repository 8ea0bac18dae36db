"""Structured Streaming forms of the telemetry and intake operators."""
