"""Document analytics and retrieval on Spark DataFrames."""
