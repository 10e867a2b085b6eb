"""Predicate-argument analytics and corpus preparation on Spark DataFrames."""
