"""The engine's calls as named tools with plain arguments and results."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from askframe.engine import Engine, RegistryEngine
from askframe.operators.joinpath import find_path
from askframe.plans.guard import ROW_CAP
from askframe.plans.model import PlanError, plan_from_json


class Tools:
    """Tools over one engine, and over a registry if there is one."""

    def __init__(self, engine: Engine, registry: RegistryEngine | None = None) -> None:
        self.engine, self.registry = engine, registry

    def parse_query(self, query: str) -> dict[str, Any]:
        return self.engine.parse(query).to_dict()

    def explain_query(self, query: str) -> dict[str, Any]:
        return self.engine.explain(query).to_dict()

    def execute_query(self, query: str, max_rows: int = ROW_CAP, conversation: list[dict[str, str]] | None = None) -> dict[str, Any]:
        return self.engine.execute(query, max_rows, conversation).to_dict()

    def execute_plan(self, plan: dict[str, Any], max_rows: int = ROW_CAP) -> dict[str, Any]:
        return self.engine.execute_plan(plan, max_rows).to_dict()

    def search_schema(self, query: str, top_k: int = 8) -> list[dict[str, Any]]:
        return self.engine.search_schema(query, top_k)

    def explain_schema_match(self, query: str, top_k: int = 8) -> dict[str, Any]:
        return self.engine.explain_schema_match(query, top_k)

    def inspect_schema(self) -> dict[str, Any]:
        return self.engine.catalog.to_dict()

    def find_join_path(self, source: str, target: str) -> dict[str, Any] | None:
        path = find_path(self.engine.catalog, source, target)
        return path.to_dict() if path else None

    def validate_plan(self, plan: dict[str, Any]) -> dict[str, Any]:
        try:
            problem = self.engine.analyzer.problem(plan_from_json(plan))
        except ValueError as wrong:
            problem = PlanError("INVALID_PLAN", str(wrong))
        return {"valid": problem is None, "error": problem.to_dict() if problem else None}

    def retrieval_stats(self) -> dict[str, Any]:
        return self.engine.retrieval_stats()

    def feedback_history(self, limit: int = 50) -> list[dict[str, Any]]:
        return self.engine.feedback_history(limit)

    def list_datasets(self) -> list[str]:
        return list(self.registry.catalogs) if self.registry else ["main"]

    def tools(self) -> dict[str, Callable[..., Any]]:
        return {n: getattr(self, n) for n in dir(self) if not n.startswith("_") and n not in ("tools", "engine", "registry")}
