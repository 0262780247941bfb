"""Limits on what a question may cost: rows, time, and words that only writing statements need."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import DataFrame

from askframe.plans.model import PlanError

# The caps and the words.
ROW_CAP = 100
TIMEOUT_S = 5.0
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke")

_WORDS = re.compile(r"[a-z_]+")
Result = TypeVar("Result")


def unsafe_input(text: str) -> PlanError | None:
    """A question that asks for a change."""
    found = next((w for w in _WORDS.findall(text.lower()) if w in FORBIDDEN), None)
    return PlanError("FORBIDDEN_OPERATION", f"only reading is possible, not '{found}'") if found else None


def unsafe_sql(sql: str) -> PlanError | None:
    """SQL text that does more than one read."""
    if ";" in sql:
        return PlanError("UNSAFE_SQL", "one statement only")
    found = next((w for w in _WORDS.findall(sql.lower()) if w in FORBIDDEN), None)
    return PlanError("UNSAFE_SQL", f"'{found}' is no reading") if found else None


def capped(df: DataFrame, max_rows: int = ROW_CAP, cap: int = ROW_CAP) -> DataFrame:
    """At most ``max_rows`` rows, and never more than the policy's cap, whatever limit the plan has inside."""
    if max_rows < 1:
        raise PlanError("INVALID_LIMIT", "at least one row must be asked for")
    return df.limit(min(max_rows, cap))


def timed(df: DataFrame, action: Callable[[DataFrame], Result], seconds: float = TIMEOUT_S) -> Result:
    """Run an action in a thread of its own; at the deadline its jobs are cancelled and QUERY_TIMEOUT is raised."""
    context, tag, done = df.sparkSession.sparkContext, f"ask-{uuid.uuid4().hex}", {}

    def work() -> None:
        context.addJobTag(tag)
        try:
            done["value"] = action(df)
        except BaseException as error:  # noqa: BLE001  handed to the caller below
            done["error"] = error
        finally:
            context.removeJobTag(tag)

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        context.cancelJobsWithTag(tag)
        thread.join(5)
        raise PlanError("QUERY_TIMEOUT", f"the query took more than {seconds:g} seconds")
    if "error" in done:
        raise done["error"]
    return done["value"]


def rows_of(df: DataFrame, max_rows: int = ROW_CAP, seconds: float = TIMEOUT_S) -> list[dict[str, Any]]:
    """The rows of a query at the edge of the API: capped, timed, as dicts."""
    return timed(capped(df, max_rows), lambda d: [r.asDict(recursive=True) for r in d.collect()], seconds)


def explained(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
