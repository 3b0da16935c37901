"""Inverted-index retrieval as Spark DataFrames."""
