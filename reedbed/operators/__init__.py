"""Relational and linkage operators; each takes and returns DataFrames."""
