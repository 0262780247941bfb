"""Evaluation of answers: schema linking, plan, text and result equality, and reports by category."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.engine import Answer
from askframe.plans.model import Plan

#: What a failed case failed at.
FAILURES = ("clarification", "planning", "execution", "result", "plan", "sql", "linking")


@dataclass(frozen=True)
class Scores:
    precision: float
    recall: float
    f1: float


def set_scores(found: Iterable[Any], wanted: Iterable[Any]) -> Scores:
    """Precision, recall and F1 of two sets; two empty ones agree."""
    a, b = set(found), set(wanted)
    if not a and not b:
        return Scores(1.0, 1.0, 1.0)
    hit = len(a & b)
    p, r = (hit / len(a) if a else 0.0), (hit / len(b) if b else 0.0)
    return Scores(p, r, 2 * p * r / (p + r) if p + r else 0.0)


def set_score_columns(found: str, wanted: str) -> list[Column]:
    """The same for two array columns: precision, recall, f1."""
    a, b = F.array_distinct(found), F.array_distinct(wanted)
    hit, both = F.size(F.array_intersect(a, b)), (F.size(a) == 0) & (F.size(b) == 0)
    p = F.when(both, 1.0).when(F.size(a) > 0, hit / F.size(a)).otherwise(0.0)
    r = F.when(both, 1.0).when(F.size(b) > 0, hit / F.size(b)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def linking(found: Plan, wanted: Plan) -> dict[str, Scores]:
    """How well two plans agree on tables, columns, aggregations and filters."""

    def parts(p: Plan) -> dict[str, set[Any]]:
        columns = {c.name for c in p.select if getattr(c, "name", "*") != "*"} | {a.column for a in p.aggregations} | set(p.group_by) | {f.column for f in p.filters}
        return {
            "tables": {p.source, *(j.table for j in p.joins)},
            "columns": columns,
            "aggregations": {(a.function, a.column, a.distinct) for a in p.aggregations},
            "filters": {repr(f) for f in (*p.filters, *p.having)},
        }

    a, b = parts(found), parts(wanted)
    return {k: set_scores(a[k], b[k]) for k in a}


def same_plan(a: Plan, b: Plan) -> bool:
    return a.without_trace() == b.without_trace()


def normal_sql(text: str) -> str:
    return " ".join(text.lower().split()).replace(" ,", ",")


def same_results(found: Sequence[dict[str, Any]], wanted: Sequence[dict[str, Any]], ordered: bool = False, tolerance: float = 1e-6) -> bool:
    """Whether two lists of rows agree, as multisets unless ``ordered``; numbers up to a tolerance either way."""
    if len(found) != len(wanted):
        return False

    def close(a: Any, b: Any) -> bool:
        if isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool):
            return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
        return a == b

    def same(a: dict[str, Any], b: dict[str, Any]) -> bool:
        return a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)

    def key(row: dict[str, Any]) -> str:
        return repr(sorted((k, round(float(v), 3) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)) for k, v in row.items()))

    if not ordered:
        found, wanted = sorted(found, key=key), sorted(wanted, key=key)
    return all(same(a, b) for a, b in zip(found, wanted, strict=True))


@dataclass(frozen=True)
class Case:
    id: str
    question: str
    dataset_id: str = "main"
    plans: tuple[Plan, ...] = ()
    sql: tuple[str, ...] = ()
    result: tuple[dict[str, Any], ...] | None = None
    labels: tuple[str, ...] = ()
    ordered: bool = False
    tolerance: float = 1e-6


@dataclass(frozen=True)
class Outcome:
    case: Case
    success: bool
    failure: str | None = None
    linking: dict[str, Scores] = field(default_factory=dict)


def judge(case: Case, answer: Answer) -> Outcome:
    """Results decide where they are given, then plans, then SQL text, then schema linking alone."""
    if answer.requires_clarification or not answer.success:
        kind = "clarification" if answer.requires_clarification else "execution" if answer.plan else "planning"
        return Outcome(case, False, kind)
    links = linking(answer.plan, case.plans[0]) if answer.plan and case.plans else {}
    if case.result is not None and answer.rows is not None:
        ok, kind = same_results(answer.rows, case.result, case.ordered, case.tolerance), "result"
    elif case.plans:
        ok, kind = any(answer.plan is not None and same_plan(answer.plan, p) for p in case.plans), "plan"
    elif case.sql:
        ok, kind = answer.sql is not None and normal_sql(answer.sql.sql) in {normal_sql(s) for s in case.sql}, "sql"
    else:
        ok, kind = all(s.f1 == 1.0 for s in links.values()), "linking"
    return Outcome(case, ok, None if ok else kind, links)


def evaluate(cases: Iterable[Case], ask: Callable[[str], Answer]) -> list[Outcome]:
    return [judge(c, ask(c.question)) for c in cases]


def report(outcomes: Sequence[Outcome]) -> dict[str, Any]:
    """Totals, successes by label, failures by kind and mean linking scores."""
    labels: dict[str, Counter[str]] = defaultdict(Counter)
    for o in outcomes:
        for label in o.case.labels or ("unlabelled",):
            labels[label].update(["total", "success" if o.success else "failure"])
    scores = defaultdict(list)
    for o in outcomes:
        for k, s in o.linking.items():
            scores[k].append(s.f1)
    good = sum(o.success for o in outcomes)
    return {
        "total": len(outcomes),
        "success": good,
        "success_rate": good / len(outcomes) if outcomes else 0.0,
        "labels": {k: dict(v) for k, v in sorted(labels.items())},
        "failures": dict(Counter(o.failure for o in outcomes if o.failure)),
        "linking_f1": {k: sum(v) / len(v) for k, v in scores.items()},
    }


def report_frame(outcomes: DataFrame) -> DataFrame:
    """The report by label for many outcomes, as columns label and success."""
    good = F.sum(F.col("success").cast("int"))
    return outcomes.groupBy("label").agg(F.count(F.lit(1)).alias("total"), good.alias("success"), (F.count(F.lit(1)) - good).alias("failure"))
