"""Session telemetry analytics as Spark DataFrame jobs."""
