"""Behavioural log-incident analytics on Spark DataFrames."""
