"""Operators on DataFrames outside the plan algebra."""
