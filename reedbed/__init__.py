"""Dereplication, distances, linkage and reporting for large collections of aligned sequences, on Spark DataFrames."""
