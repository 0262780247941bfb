"""A pipeline over documents; each stage filters or rewrites what the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
docs. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import bpe, decontam, linededup, ngramjoin, toxicity
from askframe.llm.common import BROADCAST_BYTES, cut, delete, shared_folder, table

#: Score from which a document counts as toxic and goes.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC. The model is fitted on the labelled ones among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    # the whole row travels as the key, so nothing is joined back
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity.score(keyed, model, "row").where(F.col("score") < TOXIC).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later copies; n_chars follows. Those that lose every full line go."""
    # the row travels as one struct, so columns named like the operator's own stay what they are
    left = linededup.dedup_lines(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n", " ")) == "")
    kept = left.where(~F.coalesce(emptied, F.lit(False)))
    shown = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in shown:
        shown["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(shown["n_chars"])
    shown["text"] = F.col("text")
    return kept.select(*[value.alias(c) for c, value in shown.items()])


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts under a key of id and text hash, which tells rows apart where ids repeat or are null."""
    return docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("key"), "text")


def _meet(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with a key among ``keys`` or, as how says, without. Keys are broadcast if they are few bytes."""
    found = cut(keys.select(F.col("key.doc_id").alias("_id"), F.col("key.h").alias("_h")).distinct())
    found = F.broadcast(found) if 16 * found.count() <= BROADCAST_BYTES else found
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_own"))
    return row.join(found, F.col("_k").eqNullSafe(found["_id"]) & (F.col("_own") == found["_h"]), how)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return _meet(docs, keys, "left_anti").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a similarity of 0.8: that of the smallest id.

    Of rows equal in id and text one stays: that whose other columns come first as JSON. A null id comes first.
    """
    groups = ngramjoin.link(_keyed(docs), "key", n=5, percent=80)
    left = _without(docs, groups.where(F.col("key") != F.col("component_id")))
    repeated = cut(_keyed(docs).groupBy("key").count().where("count > 1").select("key"))
    if repeated.isEmpty():
        return left
    again = _meet(left, repeated, "left_semi").groupBy("_k", "_own").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return _without(left, repeated).unionByName(again.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontam.find_leaks(_keyed(docs), table(spark, sf_dir, "benchmark"), "key"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document left, and whether its ids decode to its bytes."""
    keyed = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).alias("key"), "text")
    coded = bpe.encode_decode(keyed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "key")
    return coded.select(
        F.col("key.doc_id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("key.h")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]
#: SQL can't express a trained model, so neither the rows of run(). tests/llm/test_stages.py holds the rows that each stage
#: keeps against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; what each returns is written to the shared folder and reread.

    A stage's table is deleted once the next one's is written; that of the last but one is read by the result.
    """
    folder, docs, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
