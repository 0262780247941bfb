"""Logical plans: the algebra, its checks, and its lowering to DataFrames."""
