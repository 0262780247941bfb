"""Workloads of questions, and the timing of an engine on them."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from askframe.engine import Answer

#: Questions by topic.
TOPICS: dict[str, tuple[str, ...]] = {
    "housing": ("show top 5 properties by sale price", "average sale price", "show properties built after 2000", "show properties with sale price greater than 500000"),
    "traffic": ("show all traffic incidents", "count accidents", "show incidents with severity greater than 3"),
    "facilities": ("show all facilities", "count schools", "show public buildings where area is north"),
}
SEED, HOT_SHARE = 17, 0.8


@dataclass(frozen=True)
class Asked:
    text: str
    topic: str


class Workload:
    """Sequences of questions from a seeded generator."""

    def __init__(self, topics: dict[str, tuple[str, ...]] | None = None, seed: int = SEED) -> None:
        self.topics, self.random = topics or TOPICS, random.Random(seed)

    def _one(self, topic: str) -> Asked:
        return Asked(self.random.choice(self.topics[topic]), topic)

    def uniform(self, n: int) -> list[Asked]:
        return [self._one(self.random.choice(list(self.topics))) for _ in range(n)]

    def skewed(self, n: int, hot: str = "housing", share: float = HOT_SHARE) -> list[Asked]:
        others = [t for t in self.topics if t != hot]
        return [self._one(hot if self.random.random() < share else self.random.choice(others)) for _ in range(n)]

    def sudden_shift(self, n: int, before: str = "housing", after: str = "traffic") -> list[Asked]:
        return [self._one(before if i < n // 2 else after) for i in range(n)]

    def gradual_shift(self, n: int, before: str = "housing", after: str = "traffic") -> list[Asked]:
        return [self._one(after if self.random.random() < i / max(1, n - 1) else before) for i in range(n)]


def nearest_rank(values: Sequence[float], share: float) -> float:
    """The value at index round((n - 1) * share) of the sorted list, 0 for none."""
    ordered = sorted(values)
    return ordered[round((len(ordered) - 1) * share)] if ordered else 0.0


def measure(name: str, asked: Sequence[Asked], ask: Callable[[str], Answer]) -> dict[str, Any]:
    """Latencies in milliseconds, success rate and counters of a workload."""
    times, answers = [], []
    for q in asked:
        start = time.perf_counter()
        answers.append(ask(q.text))
        times.append(1000 * (time.perf_counter() - start))
    good = sum(a.success for a in answers)
    return {
        "name": name,
        "questions": len(asked),
        "p50_ms": nearest_rank(times, 0.50),
        "p95_ms": nearest_rank(times, 0.95),
        "success_rate": good / len(asked) if asked else 0.0,
        "clarifications": sum(a.requires_clarification for a in answers),
        "failures": len(asked) - good,
    }


def ablation(asked: Sequence[Asked], engines: dict[str, Callable[[str], Answer]]) -> list[dict[str, Any]]:
    """The same workload on engines that differ in one setting."""
    return [measure(name, asked, ask) for name, ask in engines.items()]


def write_reports(reports: Sequence[dict[str, Any]], folder: str) -> tuple[Path, Path]:
    """The reports as JSON and as a Markdown table."""
    home = Path(folder)
    home.mkdir(parents=True, exist_ok=True)
    columns = list(reports[0]) if reports else ["name"]
    lines = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    lines += ["| " + " | ".join(f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in columns) + " |" for r in reports]
    as_json, as_text = home / "workload.json", home / "workload.md"
    as_json.write_text(json.dumps(list(reports), indent=2))
    as_text.write_text("\n".join(lines) + "\n")
    return as_json, as_text
