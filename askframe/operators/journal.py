"""Append-only journals: feedback on plans, and what it says about a plan; conversations in windows."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.operators.profile import latest
from askframe.plans.model import Plan

# The windows.
PRIOR_WINDOW = 20
TURNS = 12
SCHEMA = "id bigint, query string, plan_signature string, success boolean, score double, error_code string, created_at double"


def plan_signature(plan: Plan) -> str:
    """A digest of what a plan does, whatever led to it."""
    return hashlib.sha256(json.dumps(plan.without_trace().to_dict(), sort_keys=True).encode()).hexdigest()


class FeedbackJournal:
    """Feedback as a Parquet folder that only grows. Ids are nanoseconds, so writers need no common counter."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def record(self, query: str, signature: str, success: bool, score: float = 1.0, error_code: str | None = None) -> int:
        """Append one entry, its score held between 0 and 1; the new id."""
        now = time.time_ns()
        row = (now, query, signature, bool(success), min(1.0, max(0.0, float(score))), error_code, now / 1e9)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return now

    def frame(self) -> DataFrame:
        if "://" not in self.path and not Path(self.path).exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def recent(self, limit: int = 50) -> DataFrame:
        """The newest entries first."""
        return self.frame().orderBy(F.desc("id")).limit(limit)

    def prior(self, query: str, signature: str) -> float:
        """Mean of the newest outcomes of a query and plan, signed; 0 without any."""
        own = self.frame().where((F.col("query") == query) & (F.col("plan_signature") == signature))
        found = priors(own, ["query", "plan_signature"], "id", F.col("success"), F.col("score")).first()
        return 0.0 if found is None else float(found["prior"])


def priors(df: DataFrame, by: Sequence[str], order: str, success: Column, score: Column, window: int = PRIOR_WINDOW) -> DataFrame:
    """Signed mean of the newest ``window`` outcomes of each group."""
    newest = latest(df, by, order, window)
    return newest.groupBy(*by).agg(F.round(F.avg(F.when(success, score).otherwise(-score)), 6).alias("prior"))


def conversation_window(df: DataFrame, turns: int = TURNS) -> DataFrame:
    """The last turns of each conversation, then those of users and assistants that say anything."""
    return latest(df, ["conv_id"], "turn", turns).where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))


@dataclass(frozen=True)
class Conversation:
    """The turns that a question may refer to: the last of those given, valid ones only."""

    messages: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, history: Iterable[Mapping[str, Any]] | None) -> Conversation:
        said = [(str(m.get("role", "")), str(m.get("content") or "").strip()) for m in list(history or [])[-TURNS:]]
        return cls(tuple((r, c) for r, c in said if r in ("user", "assistant") and c))

    def as_messages(self) -> list[dict[str, str]]:
        return [{"role": r, "content": c} for r, c in self.messages]
