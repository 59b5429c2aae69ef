"""Catalogue, search and ranking jobs on Spark DataFrames."""
