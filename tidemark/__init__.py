"""Environmental time-series analytics as plain functions over Spark DataFrames."""
