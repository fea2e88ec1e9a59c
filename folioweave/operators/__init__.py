"""Operators over the section graph; each takes and returns DataFrames."""
