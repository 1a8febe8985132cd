"""Operators a user calls: every function takes and returns DataFrames."""
