"""Laboratory telemetry and stock analytics as Spark DataFrame operators."""
