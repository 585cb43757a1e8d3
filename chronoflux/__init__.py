"""Event-timing analytics on Spark: DataFrames in, DataFrames out."""
