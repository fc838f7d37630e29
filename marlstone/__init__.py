"""Market-data analytics on Spark DataFrames, SQL and Structured Streaming."""
