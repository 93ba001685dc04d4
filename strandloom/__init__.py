"""Repeat/spacer-array analytics and corpus preparation on Spark DataFrames."""
