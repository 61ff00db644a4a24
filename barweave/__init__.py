"""barweave: market time-series analytics expressed as Spark DataFrames."""
