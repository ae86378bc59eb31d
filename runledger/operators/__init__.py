"""Operators over all runs at once; each takes and returns DataFrames."""
