"""Vectors as arrays of doubles: hashed n-gram embeddings and cosine similarity, native and on the driver."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 128
_TOKENS = re.compile(r"[a-z0-9_]+")


def tokens(text: str) -> list[str]:
    return _TOKENS.findall(text.lower())


def embed(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Words and word pairs hashed into signed buckets, at length 1; zeros for a text without words."""
    words = tokens(text)
    out = [0.0] * dimensions
    for gram in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        digest = hashlib.sha256(gram.encode()).hexdigest()
        out[int(digest[:8], 16) % dimensions] += 1.0 if int(digest[8:10], 16) % 2 == 0 else -1.0
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else out


def similarity(a: Sequence[float], b: Sequence[float]) -> float:
    """Cosine; 0 for different lengths, empty and zero vectors."""
    if not a or len(a) != len(b):
        return 0.0
    la, lb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (la * lb) if la and lb else 0.0


def bucket(gram: Column, dimensions: int = DIMENSIONS) -> Column:
    """The bucket of a gram: the first 32 bits of its SHA-256, modulo."""
    return F.conv(F.substring(F.sha2(gram, 256), 1, 8), 16, 10).cast("bigint") % dimensions


def sign(gram: Column) -> Column:
    """1 or -1 by the parity of the fifth byte."""
    return F.when(F.conv(F.substring(F.sha2(gram, 256), 9, 2), 16, 10).cast("bigint") % 2 == 0, 1.0).otherwise(-1.0)


def column_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def embed_texts(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key`` and ``vector`` for each row: grams are exploded and summed by bucket, so no row needs Python.

    ``key`` must be unique. Texts without words get zeros.
    """
    words = df.select(F.col(key), column_tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    grams = words.select(key, F.explode_outer(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("g"))
    sums = grams.groupBy(key, bucket(F.col("g"), dimensions).alias("b")).agg(F.sum(sign(F.col("g"))).alias("x"))
    found = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "x")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0)))
    made = found.select(key, dense.alias("v"))
    return made.select(key, unit(F.col("v")).alias("vector"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    length = F.sqrt(_dot(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, in doubles; 0 for different lengths, empty and zero vectors."""
    length = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (length > 0), _dot(a, b) / length).otherwise(0.0)
