"""Code-impact analytics on Spark DataFrames."""
