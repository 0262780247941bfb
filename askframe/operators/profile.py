"""Column profiles, shares and distances, by aggregations that read each column once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 12
#: Exact distinct counts multiply the rows of an aggregation, so no more columns than these share one.
BATCH = 5
#: Buckets into which values are dealt to be ranked.
BUCKETS = 64


def null_ratio(rows: Column, full: Column) -> Column:
    """The share of nulls to four decimals, 0 for no rows."""
    return F.when(rows == 0, 0.0).otherwise(F.round((rows - full) / rows, 4))


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """A row for each column: counts, distinct values, least and greatest as text, null ratio.

    ``approximate`` counts distinct values with sketches, in one aggregation over all columns.
    """
    names = list(columns or df.columns)
    size = len(names) if approximate else BATCH
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    parts = []
    for start in range(0, len(names), size):
        some = names[start : start + size]
        measures = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(some):
            c = F.col(f"`{name}`")
            measures += [F.count(c).alias(f"full_{i}"), distinct(c).alias(f"distinct_{i}"), F.min(c).cast("string").alias(f"low_{i}"), F.max(c).cast("string").alias(f"high_{i}")]
        each = [
            F.struct(
                F.lit(name).alias("column_name"),
                F.col("rows").alias("row_count"),
                F.col(f"full_{i}").alias("non_null_count"),
                F.col(f"distinct_{i}").alias("distinct_count"),
                F.col(f"low_{i}").alias("minimum"),
                F.col(f"high_{i}").alias("maximum"),
                null_ratio(F.col("rows"), F.col(f"full_{i}")).alias("null_ratio"),
            )
            for i, name in enumerate(some)
        ]
        parts.append(df.agg(*measures).select(F.inline(F.array(*each))))
    return reduce(DataFrame.union, parts)


def samples(df: DataFrame, column: str, most: int = SAMPLES) -> DataFrame:
    """The smallest distinct values of a column, as text: a sorted top-k, never the whole set in one place."""
    return df.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct().orderBy("v").limit(most).select(F.col("v").cast("string").alias("value"))


def nearest_rank(df: DataFrame, column: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Values at index round((n - 1) * share) of the sorted column, halves to even.

    Ranks come from counts by value, so a task holds running counts of distinct values, not the rows. Values are dealt
    out by limits that are fixed before anything is counted, so every use of a bucket means the same values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    limits = sorted(set(counts.approxQuantile("v", [i / BUCKETS for i in range(1, BUCKETS)], 1 / (2 * BUCKETS))))
    below = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col("v").cast("double"))) if limits else F.lit(0)
    parts = counts.select("v", "n", below.alias("p"))
    before = parts.groupBy("p").agg(F.sum("n").alias("part"))
    offset = F.coalesce(F.sum("part").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = before.agg(F.coalesce(F.sum("part"), F.lit(0))).scalar()
    up_to = F.sum("n").over(Window.partitionBy("p").orderBy("v")) + F.col("offset")
    placed = parts.join(F.broadcast(before.select("p", offset.alias("offset"))), "p").withColumn("up_to", up_to).withColumn("total", total)
    picks = []
    for share, name in zip(shares, names, strict=True):
        index = F.rint((F.col("total") - 1) * share)
        picks.append(F.max(F.when((F.col("up_to") > index) & (F.col("up_to") - F.col("n") <= index), F.col("v"))).alias(name))
    return placed.agg(*picks)


def label_report(df: DataFrame, label: str, success: Column) -> DataFrame:
    """Totals and successes by label."""
    return df.groupBy(F.col(label).cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(success, 1).otherwise(0)).cast("bigint").alias("success"))


def shift_distance(history: DataFrame, recent: DataFrame, key: str) -> DataFrame:
    """Total-variation distance of two distributions over a key: half the sum of the differences of shares."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("k", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias(name))

    both = shares(history, "a").join(shares(recent, "b"), "k", "full")
    apart = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.agg(F.round(F.sum(apart) / 2, 6).alias("distance"))


def latest(df: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """The ``n`` rows of each group that come last."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
