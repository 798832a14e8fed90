"""hopline: analytics for sequenced media and telemetry streams on PySpark."""
