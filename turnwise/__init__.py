"""turnwise: conversation analytics on Spark DataFrames."""
