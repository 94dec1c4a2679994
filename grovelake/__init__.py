"""Merkle snapshot analytics and training-data operators on Spark DataFrames."""
