"""Statements to DataFrames: text queries and the plan API."""
