"""Retrieval, evaluation and corpus operators on Spark DataFrames."""
