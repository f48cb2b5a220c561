"""Corpus processing, hybrid retrieval and analytics on Spark DataFrames."""
