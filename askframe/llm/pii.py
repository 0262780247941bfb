"""Personal data in texts, with deobfuscation that keeps the offsets of the source."""

from __future__ import annotations

import io
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from askframe.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: A match can only start where a run of digits does, and takes whole runs: no backtracking on long ones.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".",
    "\u3002": ".", "\u00b7": ".", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
#: Characters without width, which are dropped.
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
#: Number words of the languages handled.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT = "at|arroba|chez|ät"
_DOT = "dot|punkt|punto|point"
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DROPPED = re.compile("[" + "".join(sorted(INVISIBLE)) + "]")
# Every repeat that could be tried in several ways is possessive, so that a match costs no more than its text.
#: A bracketed word for at or dot; the white space before it belongs to it as well.
_BRACKETED = re.compile(rf"[\[({{<]\s*+(?:({_AT}|@)|({_DOT}|\.))\s*+[\])}}>]\s*+", re.I)
#: What stands between a local part and the end of a domain, with dots as signs or words.
_SPOKEN = re.compile(
    rf"(?<=[A-Za-z0-9._%+-])(?P<at>\s++(?:{_AT})\s++|\s*+@\s*+)(?P<domain>[A-Za-z0-9-]++(?:(?:\.|\s++(?:{_DOT})\s++)[A-Za-z0-9-]++)++)", re.I
)
_TOP = re.compile(r"\.[A-Za-z]{2,}\Z")
_SPOKEN_DOT = re.compile(rf"\s++(?:{_DOT})\s++", re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9])\s++(?:{_DOT})\s++(?=[0-9])", re.I)
#: Three digits or more, one of them as a word, with separators only before another of them.
_SPELLED = re.compile(rf"(?<!\w)(?:plus\s++)?(?:(?:{_WORDS}|[0-9])(?:[\s,.-]++(?=(?:{_WORDS}|[0-9]++)(?!\w)))?+){{3,}}+(?!\w)", re.I)
#: A number word before another or digits, in lower case: without a flag for case, a search skips to letters that begin one.
_SPELLED_HINT = re.compile(rf"(?:{_WORDS})(?=[\s,.-]++(?:{_WORDS}|[0-9]++)(?!\w))")
#: Letters that patterns without case take for i and s, though lower() doesn't.
_FOLDED = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))
_UNIT = re.compile(rf"(?:{_WORDS})|plus|[0-9]|[\s,.-]+", re.I)


def luhn(digits: str) -> bool:
    """Whether a string of digits passes Luhn's check."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _octets(found: str) -> bool:
    return all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in found.split(".")))


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def detect(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and then start: leftmost, not overlapping within a kind, checked once."""
    spans: list[Span] = [("email", *x) for x in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


class Rewrite:
    """A text with disguises undone in steps, and the way back from its offsets to those of the source.

    Each step holds four numbers for each edit (where it begins and ends in the new text and in the old one), so memory
    grows with the edits, not with the text.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.steps: list[tuple[array, array, array, array]] = []

    def apply(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a text, for edits in order that don't overlap."""
        columns = array("q"), array("q"), array("q"), array("q")
        out, at, place = io.StringIO(), 0, 0
        for left, right, new in edits:
            out.write(self.text[at:left])
            out.write(new)
            place += left - at
            for column, value in zip(columns, (place, place + len(new), left, right), strict=True):
                column.append(value)
            place += len(new)
            at = right
        if columns[0]:
            out.write(self.text[at:])
            self.text = out.getvalue()
            self.steps.append(columns)

    def source(self, left: int, right: int) -> tuple[int, int]:
        """The source's span that the characters from ``left`` to before ``right`` stand for."""
        for begin, end, old_begin, old_end in reversed(self.steps):
            i, j = bisect_right(begin, left) - 1, bisect_right(begin, right - 1) - 1
            # of edits that leave nothing, those at the very place come before the character
            left = left if i < 0 else old_begin[i] if left < end[i] else left - end[i] + old_end[i]
            right = right if j < 0 else old_end[j] if right - 1 < end[j] else right - end[j] + old_end[j]
        return left, right


def _plain(char: str) -> str:
    wide = HOMOGLYPHS.get(char) or unicodedata.normalize("NFKC", char)
    return wide if len(wide) == 1 and wide.isascii() else char


#: From a character to the one it is disguised as: letters alike, full-width forms and mathematical letters.
_ALIKE = {
    ord(c): new
    for c in [*HOMOGLYPHS, "﹒", "﹫", *map(chr, range(0xFF01, 0xFF5F)), *map(chr, range(0x1D400, 0x1D800))]
    if (new := _plain(c)) != c
}
#: A set, as a pattern's class goes through all characters beyond the first plane one by one.
_OTHER = frozenset(map(chr, _ALIKE))


def _hints(text: str) -> bool:
    """Whether a number word, in any case and not inside a longer word, stands before another one or digits."""
    if not text.isascii():
        for letter, plain in _FOLDED:
            text = text.replace(letter, plain)
    lower = text.lower()
    return any(not (m.start() and re.match(r"\w", lower[m.start() - 1])) for m in _SPELLED_HINT.finditer(lower))


def _spelled(found: re.Match) -> list[tuple[int, int, str]]:
    edits, whole = [], found[0]
    for unit in _UNIT.finditer(whole):
        word = unit[0].lower()
        new = "+" if word == "plus" else DIGIT_WORDS.get(word)
        if new is None and not word.isdigit() and unit.end() < len(whole):
            new = ""
        if new is not None:
            edits.append((found.start() + unit.start(), found.start() + unit.end(), new))
    return edits


def _local_dots(text: str, at: int, last: int) -> list[tuple[int, int, str]]:
    """Edits for the spoken dots of the local part that ends at ``at``, looked for back to ``last``."""
    edits = []
    back = lambda i, test: next((j for j in range(i, last, -1) if not test(text[j - 1])), last)
    start = back(at, _LOCAL.__contains__)
    while True:
        end = back(start, str.isspace)
        word = back(end, str.isalpha)
        left = back(word, str.isspace)
        if not (left < word < end < start and left > last and text[word:end].lower() in _DOT.split("|") and text[left - 1] in _LOCAL):
            return edits[::-1]
        edits.append((left, start, "."))
        start = back(left, _LOCAL.__contains__)


def _spoken(text: str) -> list[tuple[int, int, str]]:
    """Edits for addresses with words for at or dot; with an at alone, the domain must end like a name, not a number."""
    edits: list[tuple[int, int, str]] = []
    last = 0
    for m in _SPOKEN.finditer(text):
        dots = [(*d.span(), ".") for d in _SPOKEN_DOT.finditer(text, *m.span("domain"))]
        if dots or "@" in m["at"] or _TOP.search(m["domain"]):
            edits += _local_dots(text, m.start(), last)
            edits += [(*m.span("at"), "@")] * (m["at"] != "@") + dots
            last = m.end()
    return edits


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    last = 0
    for m in _BRACKETED.finditer(text):
        left = m.start()
        while left > last and text[left - 1].isspace():
            left -= 1
        last = m.end()
        yield left, last, "@" if m[1] else "."


def normalise(text: str) -> Rewrite | None:
    """The text with its disguises undone, or None if it has none of them."""
    lower = text.lower()
    bracket = any(x in text for x in "[({<")
    dotted = any(x in lower for x in _DOT.split("|"))
    other = not text.isascii() and (not _OTHER.isdisjoint(text) or _DROPPED.search(text))
    spelled = _hints(text)
    if not (other or spelled or (bracket and _BRACKETED.search(text)) or (dotted and _DIGIT_DOT.search(text)) or _spoken(text)):
        return None
    out = Rewrite(text.translate(_ALIKE) if other else text)
    if other:
        out.apply((*m.span(), "") for m in _DROPPED.finditer(out.text))
    if bracket:
        out.apply(_bracketed(out.text))
    out.apply(_spoken(out.text))
    out.apply((*m.span(), ".") for m in _DIGIT_DOT.finditer(out.text))
    if spelled or _hints(out.text):
        out.apply(e for m in _SPELLED.finditer(out.text) if not _digits(m[0]) == m[0] for e in _spelled(m))
    return out if out.steps or out.text != text else None


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans by kind and start, with whether the base patterns found it.

    A span that only the normalised text shows is added if it reads otherwise than the source does there and overlaps no
    base span of its kind.
    """
    base = detect(text)
    rows = [(*x, True) for x in base]
    plain = normalise(text)
    if plain is not None:
        taken = {kind: [(s, e) for k, s, e in base if k == kind] for kind in KINDS}
        for kind, left, right in detect(plain.text):
            start, end = plain.source(left, right)
            near = bisect_right(taken[kind], (end, -1)) - 1  # the last base span that begins before the end
            free = near < 0 or taken[kind][near][1] <= start
            if free and plain.text[left:right] != text[start:end]:
                rows.append((kind, start, end, False))
    return sorted(rows, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def finder() -> Callable[[list[str]], list[pa.Array]]:
    """A function from texts to an array of their spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array([[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in find(t)] for t in texts], kind)]

    return run


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with ``spans``: kind, start, end (code points of the source, end exclusive) and base.

    ``base`` marks what the plain patterns find in the text as it is; the other spans come from the text with its
    homoglyphs, spelled digits and at/dot disguises undone, mapped back. One pass, no shuffle, time in proportion to
    the text. Null and empty texts have no spans; repeated rows are each searched; a null id stays null; other columns
    are ignored; an empty table gives an empty result.
    """
    schema = "spans array<struct<kind: string, start: int, end: int, base: boolean>>"
    return map_texts(df, id_col, text_col, schema, finder())
