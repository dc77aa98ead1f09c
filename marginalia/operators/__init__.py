"""Operators: DataFrame in, DataFrame out; nothing is collected that grows with the data."""
