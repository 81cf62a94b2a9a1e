"""Relational, statistical and model operators on DataFrames."""
