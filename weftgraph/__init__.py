"""Knowledge-graph construction and verification on Spark DataFrames."""
