"""millrace: retail event analytics on PySpark DataFrames, Spark SQL and Structured Streaming."""
