"""Operators on stored pages and the datasets made from them: DataFrames in, DataFrames out."""
