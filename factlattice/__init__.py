"""Document-to-status analytics on Spark DataFrames."""
