"""Versioned, chunked N-dimensional arrays as Spark DataFrames."""
