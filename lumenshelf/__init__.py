"""Batch jobs over very large media catalogues, on Spark DataFrames."""
