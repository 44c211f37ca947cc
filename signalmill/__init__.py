"""Market-signal analytics expressed as Spark DataFrame, SQL and streaming jobs."""
