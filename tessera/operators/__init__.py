"""Operators over the memory graph: every one takes DataFrames, gives a DataFrame and is batched over groups or queries."""
