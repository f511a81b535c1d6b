"""Cumulative-counter analytics on Spark DataFrames and Structured Streaming."""
