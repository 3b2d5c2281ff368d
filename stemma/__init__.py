"""Stemma: verification-aware dependency analytics on Spark DataFrames."""
