"""Telemetry anomaly analytics on Spark: block and stream scoring, calibration, evaluation, statistics."""
