"""Text, file, code and corpus analytics on Spark DataFrames."""
