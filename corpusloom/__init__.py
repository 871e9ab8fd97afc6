"""Topic-model analytics on Spark DataFrames."""
