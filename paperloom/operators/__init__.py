"""Relational operators of the engine; each takes and gives DataFrames."""
