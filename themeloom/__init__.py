"""Topic discovery and corpus preparation on Spark DataFrames."""
