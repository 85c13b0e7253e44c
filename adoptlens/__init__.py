"""AI-usage operations, telemetry and evidence evaluation as Spark DataFrame functions."""
