"""Schedule and directory analytics on Spark DataFrames."""
