"""Operators on cache state and command logs: plain functions from DataFrames to a DataFrame."""
