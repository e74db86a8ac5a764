"""Network-flow analytics on Spark DataFrames."""
