"""Observation-step analytics on Spark DataFrames."""
