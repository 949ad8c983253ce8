"""Relational, spatial and graph operators on DataFrames."""
