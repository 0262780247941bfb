"""Numbers in English text."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

# Number words.
_UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"thousand": 10**3, "k": 10**3, "million": 10**6, "m": 10**6, "billion": 10**9, "bn": 10**9, "trillion": 10**12}
_LITERAL = re.compile(r"-?\$?(\d[\d,]*(?:\.\d+)?|\.\d+)(k|m|bn)?")


def _simple(word: str) -> Decimal | None:
    if word in _UNITS or word in _TENS:
        return Decimal(_UNITS.get(word, _TENS.get(word, 0)))
    found = _LITERAL.fullmatch(word)
    if not found:
        return None
    value = Decimal(found[1].replace(",", "")) * _SCALES.get(found[2] or "", 1)
    return -value if word.startswith("-") else value


def _joins(current: Decimal, value: Decimal, literal: bool) -> bool:
    """Whether a number word goes on from what has been read: twenty one, two hundred five."""
    if literal:
        return False
    return (current % 100 >= 20 and current % 10 == 0 and 0 < value < 10) or (current >= 100 and current % 100 == 0 and 0 < value < 100)


def take(words: list[str], at: int) -> tuple[Decimal, int] | None:
    """The number that begins at a word, and the index after it; None if none does.

    An ``and`` is only read between parts of one number: after a hundred or a scale and before something smaller, or
    before ``a half``.
    """
    total, current, scale, i = Decimal(0), None, Decimal(10) ** 30, at
    while i < len(words):
        word = words[i]
        value = _simple(word)
        literal = value is not None and word not in _UNITS and word not in _TENS
        following = words[i + 1] if i + 1 < len(words) else ""
        first = i == at or (i == at + 1 and words[at] in ("a", "an"))
        if value is not None and current is None and (i == at or not literal):
            if total and value >= scale:
                break
            current = value
        elif value is not None and current is not None and _joins(current, value, literal):
            current += value
        elif word == "hundred" and (current is None and first or current is not None and current < 100):
            current = (1 if current is None else current) * 100
        elif word in _SCALES and (current is not None or first and word not in ("k", "m", "bn")) and _SCALES[word] < scale:
            scale = Decimal(_SCALES[word])
            total, current = total + (1 if current is None else current) * scale, None
        elif word in ("a", "an") and i == at and following in ("hundred", *_SCALES):
            pass
        elif word == "half" and current is None and i == at:
            current = Decimal("0.5")
            if following in ("a", "an") and i + 2 < len(words) and words[i + 2] in _SCALES:
                i += 1
        elif word == "and" and (current is not None or total) and words[i + 1 : i + 3] == ["a", "half"]:
            current, i = (current or Decimal(0)) + Decimal("0.5"), i + 2
        elif word == "and" and (following in _UNITS or following in _TENS) and ((current is not None and current >= 100 and current % 100 == 0) or (current is None and total)):
            small = _simple(following) or Decimal(0)
            if "hundred" in words[i + 2 : i + 3] and current is not None or small >= scale:
                break
        else:
            break
        i += 1
    if i == at or (current is None and not total):
        return None
    return total + (current or 0), i


def parse_number(text: str) -> Decimal | None:
    """A whole text as a number: ``$1,234.5``, ``2.5 million``, ``one and a half million``; None if it is none."""
    words = re.sub(r"(?<=[a-z])-(?=[a-z])", " ", text.lower().strip()).replace("$ ", "$").split()
    try:
        found = take(words, 0)
    except InvalidOperation:
        return None
    return found[0] if found and found[1] == len(words) else None


def plain(value: Decimal) -> int | float:
    """An int if there is no fraction, else a float."""
    return int(value) if value == value.to_integral_value() else float(value)


def replace_numbers(words: list[str], kept: frozenset[str] = frozenset()) -> list[str]:
    """Words with numbers written in digits. Phrases of ``kept`` (two words) are left alone: half bath is no number."""
    out, i = [], 0
    while i < len(words):
        found = None if " ".join(words[i : i + 2]) in kept else take(words, i)
        if found:
            out.append(str(plain(found[0])))
            i = found[1]
        else:
            out.append(words[i])
            i += 1
    return out
