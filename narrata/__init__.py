"""Preparing text corpora for narration on Spark: DataFrames in, DataFrames out."""
