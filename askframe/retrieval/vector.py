"""Exact vector search and the margin between its best answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions.vectors import cosine


def search(df: DataFrame, key: str, vector: str, query: Column, top_k: int) -> DataFrame:
    """The ``top_k`` rows nearest to a query vector, an expression of one row (a literal or a scalar subquery)."""
    # a subquery can't stand inside the lambdas of a cosine, and a generator keeps it from being moved there
    beside = df.select(F.col(key), F.col(vector).alias("_v"), F.explode_outer(F.array(query)).alias("_q"))
    scored = beside.select(F.col(key), cosine(F.col("_v"), F.col("_q")).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(top_k)


def margin(df: DataFrame, key: str, vector: str, query: Column) -> DataFrame:
    """How far the best answer is ahead of the second; the best alone counts from 0."""
    best = search(df, key, vector, query, 2)
    return best.agg(F.round(F.max("score") - F.when(F.count(F.lit(1)) > 1, F.min("score")).otherwise(0.0), 6).alias("margin"))
