"""Behavioral analytics over event telemetry, on PySpark."""
