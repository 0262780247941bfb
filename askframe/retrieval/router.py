"""Which of several datasets a question is about."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass

from askframe.plans.model import PlanError
from askframe.sources.catalog import Catalog

# The thresholds of routing, and letters that are written in two ways.
LEAST, MARGIN, PHRASE = 0.25, 0.15, 0.25
_LETTERS = str.maketrans({"ي": "ی", "ك": "ک"})


def fold(text: str) -> str:
    """Compatibility forms and case folded away."""
    return unicodedata.normalize("NFKC", text).casefold().translate(_LETTERS)


def terms(text: str) -> set[str]:
    return {w for w in re.findall(r"\w+", fold(text)) if len(w) > 1}


@dataclass(frozen=True)
class Match:
    dataset_id: str
    score: float
    matched: tuple[str, ...]


class Router:
    def __init__(self, catalogs: Mapping[str, Catalog], descriptions: Mapping[str, str] | None = None) -> None:
        self.catalogs = dict(catalogs)
        self.names: dict[str, set[str]] = {}
        self.words: dict[str, set[str]] = {}
        for key, catalog in self.catalogs.items():
            said = {key, *(a for t in catalog.tables.values() for a in (*t.aliases, *(x for c in t.columns.values() for x in c.aliases)))}
            self.names[key] = {fold(x) for x in said}
            self.words[key] = set().union(*(terms(x.replace("_", " ")) for x in said), terms((descriptions or {}).get(key, "")))

    def search(self, question: str) -> list[Match]:
        """Datasets by the share of the question's words that they know, and a bonus for a phrase of several words."""
        asked, whole = terms(question), f" {fold(question)} "
        out = []
        for key, words in self.words.items():
            shared = asked & words
            score = len(shared) / len(asked) if asked else 0.0
            bonus = PHRASE if any(f" {n} " in whole for n in self.names[key] if " " in n) else 0.0
            if shared or bonus:
                out.append(Match(key, min(1.0, score + bonus), tuple(sorted(shared))))
        return sorted(out, key=lambda m: (-m.score, -len(m.matched), m.dataset_id))

    def route(self, question: str) -> str:
        """The dataset; AMBIGUOUS_DATASET if none is likely enough or two are about as likely."""
        found = self.search(question)
        if not found or found[0].score < LEAST or (len(found) > 1 and found[0].score - found[1].score < MARGIN):
            raise PlanError("AMBIGUOUS_DATASET", f"Which dataset is meant: {', '.join(self.catalogs)}?")
        return found[0].dataset_id
