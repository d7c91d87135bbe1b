"""Code-mixed corpus analytics on Spark DataFrames."""
