"""Array analytics on Spark DataFrames."""
