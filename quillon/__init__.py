"""A strictly typed SELECT engine on Spark DataFrames."""
