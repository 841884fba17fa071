"""Operators over trades and members: DataFrame in, DataFrame out."""
