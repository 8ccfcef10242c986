"""Spark-native email analytics: jobs from DataFrames to DataFrames."""
