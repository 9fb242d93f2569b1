"""Readers and projections of raw telemetry."""
