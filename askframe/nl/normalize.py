"""Questions to plain lower-case words, with numbers in digits."""

from __future__ import annotations

import re

from askframe.functions.numbers import replace_numbers

# Contractions.
CONTRACTIONS = {
    "what's": "what is",
    "who's": "who is",
    "where's": "where is",
    "how's": "how is",
    "don't": "do not",
    "doesn't": "does not",
    "isn't": "is not",
    "aren't": "are not",
    "can't": "cannot",
}
_KEPT = re.compile(r"\d{4}-\d{2}-\d{2}|-?\$?\d[\d,]*(?:\.\d+)?(?:k|m|bn)?\b|[^\W_][\w']*(?:\.\d+)?|<=|>=|!=|[<>=]")
_SIGNS = {"<": "less than", ">": "greater than", "<=": "at most", ">=": "at least", "!=": "not equal to", "=": "equal to"}


def normalize(text: str, kept_phrases: frozenset[str] = frozenset()) -> str:
    """Contractions expanded, punctuation dropped but for decimals, signs, money and ISO dates, numbers in digits."""
    lower = text.lower().replace("’", "'")
    for short, full in CONTRACTIONS.items():
        lower = lower.replace(short, full)
    words: list[str] = []
    for m in _KEPT.finditer(lower):
        word = m[0]
        before = lower[m.start() - 1] if m.start() else " "
        if word.startswith("-") and not before.isspace():
            word = word[1:]
        words += _SIGNS.get(word, word.replace("'", "")).split()
    return " ".join(replace_numbers(words, kept_phrases))
