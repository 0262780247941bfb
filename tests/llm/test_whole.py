"""Cases in which operators did less than the whole job, against brute force where results are sets of rows."""

import random
import re
import textwrap

import pytest

from askframe.llm import decontam, licenses, pii


def split_words(text):
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def brute_licenses(text, t=licenses.THRESHOLD):
    """License: dice and n_units, by going through every run of words from every word on."""
    out = {}
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    words = split_words(text)
    segments = [("\n", text.split("\n")), ("s", re.split(r"\n|(?<=\.)[ \t]+", text))]
    for name in {n for n, _ in licenses.TEMPLATES}:
        templates = [pairs(split_words(x)) for n, x in licenses.TEMPLATES if n == name]
        dice = lambda a, b: 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if a and b else 0
        units = dict.fromkeys([text, *segments[0][1], *segments[1][1]])
        scores = [(u, d) for u in units for b in templates if (d := dice(pairs(split_words(u)), b)) >= t]
        named = [False] * len(words)
        for _, parts in [("", [text]), *segments]:
            at = 0
            for part in parts:
                n = len(split_words(part))
                if part in {u for u, _ in scores}:
                    named[at : at + n] = [True] * n
                at += n
        runs = []
        for b in templates:
            most = int(len(b) * (2 - t) / t + 1e-9)
            held = pairs(words)
            for a in (i for i, x in enumerate(held) if x in set(b)):
                seen, shared, best = set(), 0, (0, a)
                for z in range(a, min(a + most, len(held))):
                    shared += held[z] in set(b) - seen
                    seen.add(held[z])
                    best = max(best, (2 * shared / (len(seen) + len(set(b))), -z - 1))
                if best[0] >= t:
                    runs.append((a, -best[1], best[0]))
        merged = []
        for a, z, _ in sorted(runs):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        alone = [m for m in merged if not any(named[m[0] : m[1] + 1])]
        if scores or runs:
            out[name] = (round(max([d for _, d in scores] + [d for *_, d in runs]), 6), len(scores) + len(alone))
    return out


def test_licenses_across_lines(spark):
    rng = random.Random(3)
    code = lambda n: "\n".join(f"int x{rng.randrange(99)} = of the software; return y{i} or the copyright" for i in range(n))
    texts = ["Copyright 2024 John Smith, Released under the MIT License.", "Released under the MIT License. Licensed under the\nMIT License, see"]
    for name in ("MIT", "BSD-3-Clause", "GPL-3.0"):
        body = next(x for n, x in licenses.TEMPLATES if n == name)
        comment = "\n".join(f" * {line}" for line in textwrap.wrap(body, 50))
        texts += [f"{code(4)}\n/*\n{comment}\n */\n{code(30)}", f"{comment}\n{code(30)}\n{comment}"]
        noisy = [w for w in body.split() if rng.random() > 0.06]
        texts.append(f"{code(2)}\n" + "\n".join(textwrap.wrap(" ".join(noisy), 60)) + f"\nReleased under the MIT License.\n{code(20)}")
    texts += [code(20), "", "the " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.dice, r.n_units)
    assert got == {i: found for i, t in enumerate(texts) if (found := brute_licenses(t))}
    assert got[0] == {"MIT": (1.0, 1)} and got[2] == {"MIT": (1.0, 1)} and got[3] == {"MIT": (1.0, 2)}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("host 192 dot 168 dot 0 dot 1 is up", ["192 dot 168 dot 0 dot 1"]),
        ("host 192.168 dot 0.1 is up", ["192.168 dot 0.1"]),
        ("write to name at host.com today", ["name at host.com"]),
        ("write to name at mail.host dot com today", ["name at mail.host dot com"]),
        ("ask john dot smith at ex dot com now", ["john dot smith at ex dot com"]),
        ("ask john dot a.b dot smith @ ex.com now", ["john dot a.b dot smith @ ex.com"]),
        ("open at 10.30, or 3 point 5 at 1.2m", []),
        ("plain a@b.org", []),
        ("a dot b at c dot d and e at f dot g", ["a dot b at c dot d", "e at f dot g"]),
    ],
)
def test_spoken_dots(text, found):
    assert [text[s:e] for _, s, e, base in pii.find(text) if not base] == found


def test_long_units(spark):
    mit = licenses.TEMPLATES[0][1]
    line = "Released under the MIT License. " * 400
    texts = ["\n\n".join("\n".join(textwrap.wrap(mit, 60)) for _ in range(8)), line]
    assert all(len(t) > 5000 for t in texts)
    got = {r.doc_id: (r.license, r.dice, r.n_units) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: ("MIT", *brute_licenses(t)["MIT"]) for i, t in enumerate(texts)}


def test_short_items(spark):
    docs = [(1, "What is the capital of France, they ask"), (2, "capital France"), (3, None), (4, "Paris!"), (5, "one two three four five six seven")]
    items = [(1, "Capital of France?"), (2, "paris"), (3, "two three four five"), (4, "one two three four five"), (5, ""), (6, "of the")]
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    runs = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    wanted = {
        (d, i, 1, 1, 1.0)
        for d, text in docs
        for i, item in items
        if (words := split_words(item)) and tuple(words) in runs(split_words(text or ""), len(words))
    }
    assert {tuple(r) for r in found} == wanted and len(found) == 4
