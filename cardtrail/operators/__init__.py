"""Relational operators of the tracing jobs, over DataFrames."""
