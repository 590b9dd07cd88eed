"""Tidemark: telemetry anomaly detection and evidence retrieval as Spark jobs."""
