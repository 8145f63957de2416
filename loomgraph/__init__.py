"""Graph and vector retrieval analytics on Spark DataFrames."""
