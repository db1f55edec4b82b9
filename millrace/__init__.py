"""Graph analytics over plant drawings and tables, on Spark DataFrames."""
