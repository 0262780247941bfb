"""Word overlap of texts and a question."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions.vectors import column_tokens, tokens

#: Score of a document one of whose aliases stands in the question.
ALIAS_SCORE = 0.85


def overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct words (an array) that a text has."""
    asked = F.array_distinct(question)
    shared = F.size(F.array_intersect(F.array_distinct(column_tokens(text)), asked))
    return F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(0.0)


def search(df: DataFrame, key: str, text: str, question: str, top_k: int, aliases: str | None = None) -> DataFrame:
    """The best ``top_k`` rows by overlap, or ALIAS_SCORE where one of ``aliases`` is part of the question; zeros go."""
    words = tokens(question)
    score = overlap(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), F.col(text))
    if aliases is not None:
        named = F.exists(aliases, lambda a: F.lit(question.lower()).contains(F.lower(a)))
        score = F.least(F.lit(1.0), F.when(named, F.greatest(score, F.lit(ALIAS_SCORE))).otherwise(score))
    return df.select(F.col(key), score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(top_k)


def score(question: str, text: str, aliases: Iterable[str] = ()) -> float:
    """The same for one document on the driver."""
    asked = set(tokens(question))
    share = len(asked & set(tokens(text))) / len(asked) if asked else 0.0
    named = any(a and a.lower() in question.lower() for a in aliases)
    return min(1.0, max(share, ALIAS_SCORE) if named else share)
