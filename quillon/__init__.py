"""A semantic query engine planned straight into Spark DataFrames."""
