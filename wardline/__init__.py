"""wardline: host-telemetry analytics written with Spark's DataFrame, SQL and streaming APIs."""
