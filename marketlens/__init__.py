"""Market-intelligence analytics as Spark DataFrame, SQL and Structured Streaming pipelines."""
