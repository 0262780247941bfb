"""Benchmark decontamination: MinHash containment search by size of the test items, in DataFrames only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import Scratch, cut, held

#: Words of a shingle, and the share of an item's shingles that a document must hold.
WORDS = 5
THRESHOLD = 0.8


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def shingles(df: DataFrame, text: str, n: int, out: str, short: Sequence[int] = (), whole: bool = False) -> DataFrame:
    """``df`` with an array of hashes, one for each ``n`` consecutive words.

    With fewer words it is empty, or with ``whole`` one hash of all of them. One for each run of ``short`` words is added.
    Words are hashed once and shingles are hashes of those.
    """
    hashed = held(df, out, F.transform(words(text), lambda w: F.xxhash64(w)))
    each = lambda i, k: F.xxhash64(*[F.get(F.col(out), i + j) for j in range(k)])
    none = F.array().cast("array<bigint>")

    def runs(k: int) -> Column:
        return F.when(F.size(out) >= k, F.transform(F.sequence(F.lit(0), F.size(out) - k), lambda i: each(i, k))).otherwise(none)

    value = runs(n)
    for k in range(1, n) if whole else ():
        value = F.when(F.size(out) == k, F.array(each(F.lit(0), k))).otherwise(value)
    return held(hashed, out, F.concat(value, *[runs(k) for k in short]) if short else value)


def least(n: Column, threshold: float) -> Column:
    """The smallest whole number of shingles that is ``threshold`` of ``n``, reckoned in millionths."""
    return F.ceil(F.lit(round(threshold * 1_000_000)) * n.cast("long") / F.lit(1_000_000)).cast("int")


def signatures(items: DataFrame, threshold: float) -> DataFrame:
    """Items by size: the classes of items of n shingles get the n - least(n) + 1 smallest hashes as signature.

    A document that holds ``threshold`` of an item's shingles lacks at most n - least(n) of them, so it holds one of its
    signature at least: the search by smallest hashes loses nothing, however long the document is.
    """
    length = F.col("n") - least(F.col("n"), threshold) + 1
    return items.select("item", F.explode(F.slice(F.sort_array("sh"), F.lit(1), length)).alias("hash"))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    n: int = WORDS,
) -> DataFrame:
    """Pairs of a document and an item whose shingles it holds: ids, ``n_shingles``, ``n_shared`` and ``containment``.

    Words are lower-cased runs of letters and digits. An item with fewer than ``n`` words is one shingle, all of it,
    and a document holds it where the same words follow each other. Null and empty texts are never found. Rows of documents or items that share an id are compared one by one and the
    best pair of ids is returned once; a null id is an id like others. Other columns are ignored. Empty tables give an
    empty result. Documents are read without a shuffle while the signatures are few bytes; beyond, both are shuffled by
    hash, and Spark can split the join at a hot one.
    """
    listed = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t"))
    # the lengths of short items, n - 1 of them at most
    short = sorted(r[0] for r in listed.select(F.size(words("t")).alias("k")).where(F.col("k").between(1, n - 1)).distinct().collect())
    listed = shingles(listed, "t", n, "sh", whole=True).select("item_id", F.array_distinct("sh").alias("sh"))
    listed = listed.where(F.size("sh") > 0).distinct().withColumn("n", F.size("sh"))
    scratch = Scratch(docs.sparkSession)
    listed = scratch.cut(listed.withColumn("item", F.struct(F.col("item_id"), F.xxhash64("sh").alias("h"))))
    signed = scratch.cut(signatures(listed, threshold))
    key = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    texts = docs.select(key.alias("doc"), F.col(text_col).alias("t"))
    each = shingles(texts, "t", n, "sh", short).select("doc", F.explode_outer("sh").alias("hash"))
    pairs = scratch.cut(each.join(scratch.small(signed), "hash").select("doc", "item").distinct())
    some = texts.join(scratch.small(scratch.cut(pairs.select("doc").distinct())), "doc", "left_semi")
    some = shingles(some, "t", n, "sh", short).select("doc", F.array_distinct("sh").alias("held")).dropDuplicates(["doc"])
    wanted = listed.select("item", "n", "sh")
    both = some.join(scratch.small(pairs), "doc").join(F.broadcast(wanted) if scratch.small(listed) is not listed else wanted, "item")
    shared = F.size(F.array_intersect("held", "sh"))
    exact = both.select("doc", "item", F.col("n"), shared.alias("shared")).where(F.col("shared") >= least(F.col("n"), threshold))
    best = F.max(F.struct((F.col("shared") / F.col("n")).alias("c"), "n", "shared")).alias("best")
    ids = [F.col("doc.doc_id").alias("doc_id"), F.col("item.item_id").alias("item_id")]
    found = exact.groupBy(*ids).agg(best).select(
        F.col("doc_id").alias(id_col),
        F.col("item_id").alias(item_col),
        F.col("best.n").cast("long").alias("n_shingles"),
        F.col("best.shared").cast("long").alias("n_shared"),
        F.round("best.c", 6).alias("containment"),
    )
    found = cut(found)
    scratch.close()
    return found


#: The same pairs for the tables documents and benchmark.
SQL = r"""
WITH cut AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x != '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x != '') FROM benchmark
), sets AS (
  SELECT DISTINCT side, id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM cut WHERE len(w) >= 5
), sizes AS (
  SELECT id, count(*) AS n FROM sets WHERE side = 'i' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM sets d JOIN sets i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_shingles, n_shared, round(n_shared / n, 6) AS containment
FROM shared JOIN sizes ON item_id = id WHERE 100 * n_shared >= 80 * n
"""
