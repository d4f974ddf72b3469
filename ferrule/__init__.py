"""Semantic retrieval over layered stores of records and vectors, on Spark DataFrames."""
