"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import Scratch, map_texts

#: Labelled rows that the trees are fitted on, at most: those of the smallest hash of text and id.
FIT_ROWS = 40_000
#: A term is learned if so many toxic texts hold it and its odds in toxic texts are so many times those elsewhere. The
#: first number is a share of all (term, toxic text) pairs where that is more, so at most LEXICON_ROWS terms of a kind can
#: pass: nothing that passes is cut off.
MIN_TEXTS, MIN_ODDS = 5, 8.0
LEXICON_ROWS = 200_000
#: Texts of each label from which those that calibrate are kept from the lexicon; fewer would cost it too much.
MIN_APART = 25
#: Code points of the word beginnings that are learned beside whole words, for languages that build or bend words.
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)

# Second-person words, and insults that are known without any label.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur thou thee du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros os".split()
)
INSULTS = frozenset(
    "idiot idiots moron stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool imbecile jerk "
    "dummkopf trottel idiota estúpido estúpida imbécil tonto basura crétin abruti connard débile stupide".split()
)
#: Characters written in place of letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![^\W_])[^\W\d_]+[@$!*0134578]+[^\W_]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
_NEAR = 3

FEATURES = (
    "words", "insult_density", "learned_density", "learned_sum", "learned_max", "stem_density", "stem_sum", "stem_max",
    "hits", "you_density", "you_near", "upper_share", "mark_share", "exclaim_share", "digit_share", "obfuscated_density",
    "obfuscated_hits", "symbol_share",
)

_KIND = np.zeros(256, np.int8)  # 1 upper case, 2 mark, 3 exclamation, 4 digit, 5 symbol, 6 other letter or byte of one
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = (
        1 if "A" <= _s <= "Z" else 3 if _s in "!?" else 2 if _s in ".,;:'\"()-" else 4 if "0" <= _s <= "9" else 5 if 32 < _c < 127 and not _s.isalpha() else 6 if _c > 32 else 0
    )


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings, and the terms of one text looked up in them."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    seen: dict[str, tuple[float, float, bool]] = field(default_factory=dict, repr=False)

    def weigh(self, word: str) -> tuple[float, float, bool]:
        """Weights as a word and by its beginnings, and whether it is a known insult. The memory of it is bounded."""
        found = self.seen.get(word)
        if found is None:
            stem = max((self.stems.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n), default=0.0)
            found = (self.words.get(word, 0.0), stem, word in INSULTS)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "seen": {}}


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; zeros for one without words."""
    lower = text.lower()
    words = WORD.findall(lower)
    n = max(1, len(words))
    marked = {w: x for w in set(words) if any(x := lexicon.weigh(w))}
    at = [i for i, w in enumerate(words) if w in marked] if marked else []
    hits = [marked[words[i]] for i in at]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if you and at:
        places = np.array(you)
        near = int(sum((np.abs(places - i) <= _NEAR).any() for i in at))
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=7)
    shown = max(1, int(kinds[1:].sum()))
    mixed = _MIXED.findall(lower) if kinds[3] + kinds[4] + kinds[5] else []
    spaced = _SPACED.findall(lower)
    plain = [w.translate(LEET) for w in mixed] + ["".join(WORD.findall(w)) for w in spaced]
    word_weights, stem_weights = [x[0] for x in hits], [x[1] for x in hits]
    return [
        math.log1p(len(words)),
        sum(x[2] for x in hits) / n,
        sum(x > 0 for x in word_weights) / n,
        sum(word_weights) / math.sqrt(n),
        max(word_weights, default=0.0),
        sum(x > 0 for x in stem_weights) / n,
        sum(stem_weights) / math.sqrt(n),
        max(stem_weights, default=0.0),
        min(20.0, float(len(hits))),
        len(you) / n,
        near / n,
        kinds[1] / shown,
        kinds[2] / shown,
        kinds[3] / shown,
        kinds[4] / shown,
        (len(mixed) + len(spaced)) / n,
        float(sum(any(lexicon.weigh(w)) for w in plain)),
        kinds[5] / shown,
    ]


@dataclass
class Trees:
    """Boosted regression trees for log odds; a tree is arrays of feature, threshold and leaf value by node."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Trees:
    """Newton boosting for log loss with histograms of quantile bins; complete trees of one depth, no random choice."""
    rate0 = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(limits, x.T, strict=True)], axis=1)
    width = bins + 1
    out = Trees(math.log(rate0 / (1 - rate0)), [], depth)
    margin = np.full(len(y), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            local = node - first
            total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
            for f, q in enumerate(limits):
                if not len(q):
                    continue
                cell = local * width + binned[:, f]
                gs = np.bincount(cell, g, count * width).reshape(count, width).cumsum(1)[:, : len(q)]
                hs = np.bincount(cell, h, count * width).reshape(count, width).cumsum(1)[:, : len(q)]
                right_g, right_h = total_g[:, None] - gs, total_h[:, None] - hs
                gain = gs**2 / (hs + l2) + right_g**2 / (right_h + l2) - (total_g**2 / (total_h + l2))[:, None]
                gain[(hs < 1e-3) | (right_h < 1e-3)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[first : first + count] = np.where(better, f, feature[first : first + count])
                threshold[first : first + count] = np.where(better, q[at], threshold[first : first + count])
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = np.zeros(2 ** (depth + 1) - 1)
        value[2**depth - 1 :] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        # inner nodes are padded so that one array serves every level
        pad = 2 ** (depth + 1) - 1 - len(feature)
        out.trees.append((np.r_[feature, np.zeros(pad, np.int64)], np.r_[threshold, np.full(pad, np.inf)], value))
        margin += value[node]
    return out


@dataclass
class Isotonic:
    """A rising step function, linear between its points and flat beyond them."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y).clip(0.0, 1.0)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; a virtual row of each label is spread over the ends, so that no score is quite certain."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first and last margin
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([float(label), 1.0, float(m), float(m)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            prior = blocks[-1]
            weight = prior[1] + last[1]
            blocks[-1] = [(prior[0] * prior[1] + last[0] * last[1]) / weight, weight, prior[2], last[3]]
    xs, ys = [], []
    for mean, weight, low, high in blocks:
        smooth = (mean * weight + 0.5 * 0.1) / (weight + 0.1)
        xs += [low, high] if high > low else [low]
        ys += [smooth, smooth] if high > low else [smooth]
    return Isotonic(np.array(xs), np.maximum.accumulate(np.array(ys)))


@dataclass
class Model:
    """What scoring a text needs. With no labelled row of both kinds, known insults alone set the score."""

    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic | None

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        if self.trees is None or self.calibration is None:
            return 1 - np.exp(-50 * x[:, FEATURES.index("insult_density")])
        return self.calibration(self.trees.margin(x))


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def learn_lexicon(rows: DataFrame, scratch: Scratch, most: int = LEXICON_ROWS) -> Lexicon:
    """Words and word beginnings whose odds are much higher in toxic texts, from columns ``t``, ``y`` and ``times``.

    The counts cover all rows given; rows that stand for one text say in ``times`` how many they are. At most ``most``
    terms of each kind pass, and all that pass come to the driver.
    """
    found = F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+", -1))
    each = rows.select(F.col("y") / F.col("times"), 1 / F.col("times"), F.explode_outer(found)).toDF("y", "one", "w").where("w != ''")
    counted = each.groupBy("w").agg(F.round(F.sum("y")).cast("long").alias("pos"), F.round(F.sum("one")).cast("long").alias("all"))
    counts = scratch.cut(counted)
    total = rows.agg(F.round(F.sum(F.col("y") / F.col("times"))), F.round(F.sum(1 / F.col("times")))).first()
    pos, neg = float(total[0] or 0), float((total[1] or 0) - (total[0] or 0))
    if not pos or not neg:
        return Lexicon()
    starts = F.explode_outer(F.array(*[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in PREFIXES]))
    stems = counts.select(starts.alias("w"), "pos", "all").where("w is not null").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"))

    def passed(terms: DataFrame) -> dict[str, float]:
        pairs = terms.agg(F.sum("pos")).first()[0] or 0
        enough = max(MIN_TEXTS, -(-pairs // most))
        odds = ((F.col("pos") + 0.5) / (pos + 1)) / (F.greatest(F.col("all") - F.col("pos"), F.lit(0)) + 0.5) * (neg + 1)
        kept = terms.withColumn("odds", odds).where((F.col("pos") >= enough) & (F.col("odds") >= MIN_ODDS))
        return {r["w"]: math.log(r["odds"]) for r in kept.select("w", "odds").orderBy("w").collect()}

    return Lexicon(passed(counts), passed(stems))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled rows, those with remainder 1 left out.

    Equal texts are one row, toxic if any of them is. A quarter of the texts, by hash, only calibrates; the lexicon
    counts all of the others, and those too where they are fewer than MIN_APART of a label. Trees and calibration use at
    most ``fit_rows`` texts, those of the smallest hash. Rows without a label, an id or a text, and labels other than 0
    and 1, teach nothing; if a part lacks a label, all texts teach every step. Labelled ids are joined before any text is: texts are only shuffled where labels are many bytes.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = scratch.cut(known.groupBy("k").agg(F.max("y").alias("y")))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null").where(F.coalesce(remainder("k"), F.lit(1)) != 1)
    hashed = texts.withColumn("h", F.xxhash64("t"))
    taught = hashed.select("k", "h").join(scratch.small(known), "k").groupBy("k", "h", "y").agg(F.count(F.lit(1)).alias("times"))
    unique = taught.groupBy("h").agg(F.min(F.struct("k", "times")).alias("one"), F.max("y").alias("y"))
    fold = F.pmod(F.xxhash64(F.col("h"), F.lit(3)), F.lit(4)) == 0
    unique = scratch.cut(unique.select("h", "one.k", "one.times", "y", fold.alias("fold")))
    parts = {(r["fold"], r["y"]): r["count"] for r in unique.groupBy("fold", "y").count().collect()}
    apart = all(parts.get((True, label), 0) >= MIN_APART for label in (0, 1))
    rows = hashed.join(scratch.small(unique), ["k", "h"])
    lexicon = learn_lexicon(rows.where(~F.col("fold")) if apart else rows, scratch)
    # a bounded number of texts, whatever the number of labels and of rows with one text
    chosen = scratch.cut(unique.orderBy(F.xxhash64(F.col("h"), F.lit(5)), "h").limit(fit_rows))
    keyed = hashed.join(F.broadcast(chosen), ["k", "h"]).select(F.struct("h", "y", "fold").alias("key"), "t")
    made = map_texts(keyed, "key", "t", "x array<double>", _feature_columns(lexicon))
    found = made.select("key.*", "x").dropDuplicates(["h"]).orderBy("h").collect()
    if len(found) > fit_rows:
        raise AssertionError(f"{len(found)} rows to fit on, {fit_rows} at most")
    scratch.close()
    x, y = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found], float)
    back = np.array([r["fold"] for r in found], bool)
    if len(set(y)) < 2:
        return Model(lexicon, None, None)
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        trees = fit_trees(x, y)
        return Model(lexicon, trees, fit_isotonic(trees.margin(x), y))
    trees = fit_trees(x[~back], y[~back])
    return Model(lexicon, trees, fit_isotonic(trees.margin(x[back]), y[back]))


def _feature_columns(lexicon: Lexicon) -> Callable[[list[str]], list[pa.Array]]:
    return lambda texts: [pa.array([features(t, lexicon) for t in texts], pa.list_(pa.float64()))]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and ``score``, 0 to 1: the calibrated chance that the text is toxic.

    Only the text is read: not the label, language, source or id. Null and empty texts are scored as texts without
    words. Equal texts get equal scores, repeated rows are each scored, other columns are ignored and an empty table
    gives an empty result. One pass, no shuffle; the model is a few MB at most (its lexicon is bounded).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, id_col, text_col, "score double", lambda texts: [pa.array(shared.value.scores(texts), pa.float64())])
