"""Log template mining and text analytics on Spark DataFrames."""
