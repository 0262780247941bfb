"""Exact n-gram Jaccard join with several global token orders.

A document is the set of its distinct word shingles. If two sets have a Jaccard similarity of t, then under *any* order
of all tokens their prefixes (the first |x| - ceil(t|x|) + 1 tokens) meet. Orders put tokens that many prefixes hold
last, and differ in how they order the rest. Sets that are equal are one node from the start. What fails the filter of
any order, or differs in too many bits of a parity map, is never verified.

Links are looked for in two steps. First each node is compared with one partner only: for each token the node leads
whose prefix tokens most others share, and a node's partner is the leader of most of its tokens. What links is joined
into components. Then the tokens whose nodes lie in more than one component give the pairs across components that pass
all filters, and those are compared too. A pair within one component needs no comparison, so a group of thousands of
near copies costs about as many comparisons as it has members, and still no link between components is lost.

The parity map of a set has PARITY bits, each the parity of the number of tokens in its slot. A token that only one of
two sets holds changes one bit, so sets differ in as many tokens as their maps in bits, at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askframe.llm.common import Scratch, cut, map_texts, slices
from askframe.llm.components import components

#: Words of a shingle and the least similarity of a link, in hundredths.
WORDS, PERCENT = 4, 85
#: Tokens with a hash in the lowest part of this size, in prefixes' lengths, are counted. Prefixes lie there, but for those
#: of short texts and of texts with many frequent tokens; tokens elsewhere count as repeated but not frequent.
BAND = 1.45
#: Slots of the table of token levels: a slot has the largest level of its tokens.
SLOTS = 1 << 21
#: Least and most bits of the filter for repeated tokens, which gets eight for each. It comes to the driver and goes to all
#: executors, so its size is bounded; a false bit or level costs time, never a link.
BITS = (1 << 16, 1 << 29)
#: Bits of a parity map, in 64-bit numbers.
PARITY = 256
_PARITY = [f"b{k}" for k in range(PARITY // 64)]
#: Share of frequent tokens in the band from which the other tokens of a text are counted, too.
FREQUENT = 0.25
#: Counts at which a token's level rises by one; tokens of higher levels come later in every order.
LEVELS = (12, 50, 200, 800, 3200, 12800, 51200)

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_ORDERS = np.array([1, 0xA0761D6478BD642F], np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xB5297A4D3F84D5B5
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at a time.
_BLOCK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Shingle sets of texts, as sorted distinct 64-bit hashes of their word sequences."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.up, self.down = _powers(_BASE, _BLOCK + 1), _powers(_INVERSE, _BLOCK + 1)

    def words(self, text: str) -> np.ndarray:
        """A hash of each word: A-Z lower-cased, split at ASCII white space.

        With running sums of the bytes' numbers times powers of a base, a word's polynomial is a difference of two sums,
        moved to the front by the inverse power. That is done for _BLOCK bytes at a time; a word that goes on in the next
        block is carried over, so that only the words' hashes grow with the text.
        """
        whole = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
        found, carried, size = [np.zeros(0, np.uint64)], 0, 0
        for at in range(0, len(whole), _BLOCK):
            data = whole[at : at + _BLOCK]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[data] * self.up[: len(data)], out=sums[1:])
            edges = np.diff(np.r_[True, _SPACE[data], True].astype(np.int8))
            start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
            values, sizes = (sums[end] - sums[start]) * self.down[start], (end - start).astype(np.uint64)
            if size:
                if len(start) and start[0] == 0:
                    values[0] = np.uint64((carried + int(values[0]) * pow(_BASE, size, 1 << 64)) % (1 << 64))
                    sizes[0] += np.uint64(size)
                else:
                    values, sizes = np.r_[np.uint64(carried), values], np.r_[np.uint64(size), sizes]
                carried, size = 0, 0
            if not _SPACE[data[-1]]:
                carried, size = int(values[-1]), int(sizes[-1])
                values, sizes = values[:-1], sizes[:-1]
            found.append(_mix(values + sizes))
        if size:
            found.append(_mix(np.array([carried], np.uint64) + np.uint64(size)))
        return np.concatenate(found)

    def __call__(self, text: str) -> np.ndarray:
        """One shingle of the whole sequence if there are fewer words than n, none without words."""
        ids = self.words(text)
        if not len(ids):
            return ids
        size = min(self.n, len(ids))
        total = np.full(len(ids) - size + 1, size, np.uint64)
        for k in range(size):
            total = total * _STEPS[k % 4] + ids[k : len(ids) - size + 1 + k]
            total ^= total >> np.uint64(29)
        return np.unique(_mix(total))


def prefix_length(size: int, percent: int) -> int:
    return size - (percent * size + 99) // 100 + 1


def _lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(kind)))


def _band(percent: int) -> np.uint64:
    return np.uint64(min(int(BAND * (100 - percent) / 100 * 2**64), 2**64 - 1))


def _low_tokens(n: int, band: np.uint64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for part in slices(batch, 0, 1024):
                sets = (shingler(t) for t in part.column(0).to_pylist())
                low = [s[: np.searchsorted(s, band)] for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low).view(np.int64))], names=["x"])

    return run


def _rest_of_frequent(n: int, band: np.uint64, shared):
    """Tokens beyond the band of the texts in which a share of FREQUENT or more of those in it are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, levels = Shingler(n), shared.value
        for batch in batches:
            for part in slices(batch, 0, 1024):
                found = [np.zeros(0, np.uint64)]
                for text in part.column(0).to_pylist():
                    tokens = shingler(text)
                    low = np.searchsorted(tokens, band)
                    frequent = np.count_nonzero(levels[tokens[:low] & np.uint64(SLOTS - 1)])
                    if low and frequent >= FREQUENT * low:
                        found.append(tokens[low:])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["x"])

    return run


def _levels(counts: DataFrame, levels: np.ndarray) -> np.ndarray:
    """``levels`` raised to those of counted tokens. At most a row for each slot comes to the driver."""
    level = sum(((F.col("count") >= at).cast("int") for at in LEVELS), F.lit(0)).cast("tinyint")
    slots = counts.select(F.col("x").bitwiseAND(SLOTS - 1).cast("int").alias("slot"), level.alias("level")).where("level > 0")
    found = slots.groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    out = levels.copy()
    np.maximum.at(out, found["slot"].to_numpy(), found["level"].to_numpy().astype(np.uint8))
    return out


def token_table(texts: DataFrame, n: int, percent: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The level of each slot, and the bits of the filter for repeated tokens.

    The tokens of the band are counted in all texts. Texts with many frequent ones may be members of a large group,
    whose prefixes reach beyond the band, so the levels of all their tokens are counted as well.
    """
    context, band = texts.sparkSession.sparkContext, _band(percent)
    counts = scratch.cut(texts.select("t").mapInArrow(_low_tokens(n, band), "x bigint").groupBy("x").count().where("count > 1"))
    size = min(max(BITS[0], 1 << (8 * counts.count()).bit_length()), BITS[1])
    bits = np.zeros(size // 8, np.uint8)
    bit = F.col("x").bitwiseAND(size - 1) + 1
    made = counts.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()
    for at, some in zip(made["at"].to_pylist(), made["bits"].to_pylist(), strict=True):
        bits[(at - 1) * 4096 : at * 4096] = np.frombuffer(some, np.uint8)
    levels = _levels(counts, np.zeros(SLOTS, np.uint8))
    scratch.drop(counts)
    rest = texts.select("t").mapInArrow(_rest_of_frequent(n, band, context.broadcast(levels)), "x bigint")
    return _levels(rest.groupBy("x").count().where(F.col("count") >= LEVELS[0]), levels), bits


def _order_keys(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """A number for each token that sorts by level and then by hash in this order, and tells tokens apart."""
    hashed = tokens if order == 0 else _mix(tokens * _ORDERS[order])
    return (levels[tokens & np.uint64(SLOTS - 1)].astype(np.uint64) << np.uint64(60)) | (hashed >> np.uint64(4))


def _parity(tokens: np.ndarray) -> list[int]:
    odd = np.bincount((tokens >> np.uint64(24)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _profiles(n: int, percent: int, shared):
    """Of each text its set's digest and size, its parity map, and its prefixes in both orders.

    In the first order only tokens that may repeat are kept, with their places and the last key of the whole prefix. In
    the second they are 32-bit numbers; tokens that fall together only loosen the filter.
    """
    made: list[Shingler] = []
    band = _band(percent)

    def run(texts: list[str]) -> list[pa.Array]:
        if not made:
            made.append(Shingler(n))
        levels, bits = shared.value
        top = np.uint64(8 * len(bits) - 1)
        nodes, sizes, maps, prefix, places, lasts, second = [], [], [], [], [], [], []
        for text in texts:
            tokens = made[0](text)
            nodes.append(xxhash.xxh3_128_digest(tokens.tobytes()))
            sizes.append(len(tokens))
            maps.append(_parity(tokens))
            length = prefix_length(len(tokens), percent) if len(tokens) else 0
            keys = _order_keys(tokens, levels, 0)
            order = np.argsort(keys, kind="stable")[:length]
            first = tokens[order]
            lasts.append(int(keys[order[-1]].view(np.int64)) if length else 0)
            slot = first & top
            shown = bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
            at = np.flatnonzero(shown.astype(bool) | (first >= band))
            prefix.append(first[at])
            places.append(at.astype(np.int32))
            keys = np.sort(_order_keys(tokens, levels, 1))[:length] if len(at) else keys[:0]
            second.append(np.unique((keys >> np.uint64(32)).astype(np.int32)))
        return [
            pa.array(nodes, pa.binary()),
            pa.array(sizes, pa.int32()),
            pa.array(lasts, pa.int64()),
            *(pa.array(x, pa.int64()) for x in np.array(maps, np.int64).reshape(len(texts), -1).T),
            _lists(prefix, np.int64),
            _lists(places, np.int32),
            _lists(second, np.int32),
        ]

    return run


def _needed(a: str, b: str, percent: int) -> Column:
    """The least overlap of two sets of these sizes that links them."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _fits(percent: int) -> Column:
    """Whether the sizes of two sets allow a link."""
    return (F.col("nu") * 100 >= F.col("nv") * percent) & (F.col("nv") * 100 >= F.col("nu") * percent)


def _may_link(percent: int) -> Column:
    """Whether two sets that share ``o`` tokens of their prefixes can link.

    Of the set whose prefix ends first (lu and lv are the last keys), the other's tokens up to there are all in its own
    prefix. So what that prefix doesn't share, the sets don't.
    """
    beyond = lambda n: F.ceil(F.lit(percent) * F.col(n) / F.lit(100)) - 1
    most = F.when(F.col("lu") <= F.col("lv"), beyond("nu")).otherwise(beyond("nv")) + F.col("o")
    return most >= _needed("nu", "nv", percent)


def _differ(percent: int) -> Column:
    """Whether the parity maps of two sets (b0 and so on, with u and v behind) allow a link."""
    bits = sum((F.bit_count(F.col(f"{b}u").bitwiseXOR(F.col(f"{b}v"))) for b in _PARITY), F.lit(0))
    return bits <= F.col("nu") + F.col("nv") - 2 * _needed("nu", "nv", percent)


def _pass_second(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, nu, nv) that the prefixes in the second order allow to link.

    Up to the smaller of the last keys everything is known of both sets.
    """
    sides = [placed.select(F.col("node").alias(x), F.col("q").alias(f"q{x}")) for x in ("u", "v")]
    both = pairs.join(sides[0], "u").join(sides[1], "v").withColumn("upto", F.least(F.array_max("qu"), F.array_max("qv")))
    cu, cv = (F.filter(q, lambda k: k <= F.col("upto")) for q in ("qu", "qv"))
    met = F.size(F.array_intersect("qu", "qv"))
    most = F.least(F.col("nu") - F.size(cu) + met, F.col("nv") - F.size(cv) + met)
    return both.where((met >= 1) & (most >= _needed("nu", "nv", percent))).select("u", "v")


def _compared(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) that link, compared on their whole texts."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    keys = scratch.cut(wanted.join(nodes, "node").select("node", F.col("doc.id").alias("id_"), F.col("doc.h").alias("h_")))
    few = scratch.small(keys)
    # rows may share id and text
    found = scratch.cut(texts.join(few, texts["h"].eqNullSafe(few["h_"]) & texts["id"].eqNullSafe(few["id_"])).select("node", "t").dropDuplicates(["node"]))
    left, right = found.select(F.col("node").alias("u"), F.col("t").alias("tu")), found.select(F.col("node").alias("v"), F.col("t").alias("tv"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for part in slices(batch, 3, 256):
                kept, last, x = [], None, None
                for u, tu, tv in zip(*(part.column(k) for k in (0, 2, 3)), strict=True):
                    if u != last:
                        last, x = u, shingler(tu.as_py())
                    y = shingler(tv.as_py())
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(kept, pa.bool_()))

    links = scratch.cut(both.mapInArrow(run, "u bigint, v bigint"))
    scratch.drop(keys, found)
    return links


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Each row's id with ``n_shingles`` and ``component_id``, the smallest id reachable by links, itself included.

    Words are runs of anything but ASCII white space, A-Z lower-cased. With fewer words than ``n`` the whole sequence is
    the only shingle; null and empty texts, and those of white space, have none and link with nothing. Rows with equal
    sets always link, repeated rows and rows that share an id among them; each row is returned. A null id comes after
    all others and is returned as null. Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    shared = spark.sparkContext.broadcast(token_table(texts, n, percent, scratch))
    keyed = texts.select(F.struct("id", "h").alias("doc"), "t")
    maps = "".join(f"{b} bigint, " for b in _PARITY)
    schema = f"set binary, n int, last bigint, {maps}p array<bigint>, at array<int>, q array<int>"
    rows = scratch.cut(map_texts(keyed, "doc", "t", schema, _profiles(n, percent, shared)))
    full = rows.where("n > 0")
    # equal sets have equal prefixes, so the row of any one stands for the node; nodes get short numbers
    nodes = full.groupBy("set").agg(F.min(F.struct(F.col("doc.id").isNull().alias("none"), "doc")).alias("first"), F.max("n").alias("n"))
    nodes = scratch.cut(nodes.select(F.monotonically_increasing_id().alias("node"), "set", F.col("first.doc").alias("doc"), "n"))
    numbers = nodes.select("node", "set", F.col("doc").alias("chosen"))
    placed = full.where(F.size("p") > 0).join(numbers, "set").where(F.col("doc").eqNullSafe(F.col("chosen")))
    own = ["node", "n", "last", *_PARITY]
    placed = scratch.cut(placed.select(*own, "p", "at", "q").dropDuplicates(["node"]))
    # the result needs no more of a row than this
    member = cut(rows.select("doc.id", "n", "set").join(nodes.select("node", "set"), "set", "left").select("id", "n", "node"))
    scratch.drop(rows)
    postings = placed.select(*own, F.explode(F.arrays_zip("p", "at")).alias("e")).select(*own, F.col("e.at").alias("i"), F.col("e.p").alias("x"))
    shares = scratch.cut(postings.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # materialised, the tokens get an exchange of their own, and Spark can split the join at a hot one
    postings = postings.join(shares, "x")
    # the more texts share the tokens of a prefix, the closer a node is to the middle of its group
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)) + 1
    middle = F.round(F.sum(F.log("df")).over(Window.partitionBy("node")) / length, 6)
    before = F.lag("x").over(Window.partitionBy("node").orderBy("i"))
    postings = scratch.cut(postings.withColumn("middle", middle).withColumn("w", before).drop("df"))
    scratch.drop(shares)
    sided = lambda side: [F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("last").alias(f"l{side}"), *[F.col(b).alias(f"{b}{side}") for b in _PARITY]]
    names = lambda side: [side, f"n{side}", f"l{side}", *[f"{b}{side}" for b in _PARITY]]
    leader = F.max(F.struct("middle", *sided("u"))).alias("low")
    leaders = scratch.cut(postings.groupBy("x").agg(leader).where("low.u is not null").select("x", *[f"low.{c}" for c in names("u")]))
    # step 1: one partner for each node
    met = postings.join(leaders, "x").where("u != node").select(*names("u"), *sided("v"))
    votes = met.groupBy(*met.columns).agg(F.count(F.lit(1)).alias("o")).where(_fits(percent) & _differ(percent) & _may_link(percent))
    best = votes.groupBy("v").agg(F.max(F.struct("o", "u", "nu", "nv")).alias("b")).select("b.u", "v", "b.nu", "b.nv")
    best = scratch.cut(_pass_second(best, placed, percent))
    scratch.drop(leaders)
    links = _compared(best, nodes, texts, n, percent, scratch)
    # leaders stand higher in one order than those they lead, so links form trees; what lies deeper than two steps only
    # costs comparisons below
    up = links.select(F.col("v").alias("u"), F.col("u").alias("top"))
    labels = links.select("u", F.col("v").alias("node")).join(up, "u", "left").dropDuplicates(["node"])
    labels = labels.select("node", F.coalesce("top", "u").alias("component"))
    # step 2: what lies across components
    spread = scratch.cut(postings.drop("middle").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
    scratch.drop(postings)
    split = scratch.cut(spread.groupBy("x").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("x"))
    across = spread.join(split, "x", "left_semi")
    a = across.select("x", *sided("u"), F.col("i").alias("iu"), F.col("w").alias("wu"), F.col("c").alias("cu"))
    b = across.select("x", *sided("v"), F.col("i").alias("iv"), F.col("w").alias("wv"), F.col("c").alias("cv"))
    # the first token that they share leaves enough room behind it in both; pairs are formed at such tokens only
    room = lambda n, i: F.col(n) - F.col(i) >= _needed("nu", "nv", percent)
    # nor at one that comes after the same shared token in both: the first that they share has others before it
    first_met = F.col("wu").isNull() | F.col("wv").isNull() | (F.col("wu") != F.col("wv"))
    meet = a.join(b, (a["x"] == b["x"]) & (F.col("cu") < F.col("cv")) & first_met & _fits(percent) & room("nu", "iu") & room("nv", "iv") & _differ(percent))
    pairs = scratch.cut(meet.select("u", "v", "nu", "nv", "lu", "lv").distinct().join(best, ["u", "v"], "left_anti"))
    scratch.drop(spread, split)
    sides = [placed.select(F.col("node").alias(x), F.col("p").alias(f"p{x}")) for x in ("u", "v")]
    both = pairs.join(sides[0], "u").join(sides[1], "v")
    passed = scratch.cut(both.withColumn("o", F.size(F.array_intersect("pu", "pv"))).where(_may_link(percent)).select("u", "v", "nu", "nv"))
    passed = scratch.cut(_pass_second(passed, placed, percent))
    more = _compared(passed, nodes, texts, n, percent, scratch)
    labels = components(links.unionByName(more))
    scratch.close()
    # the smallest id of all rows of a component
    member = member.join(labels, "node", "left").select("id", "n", F.coalesce("component", "node").alias("c"))
    least = cut(member.where("n > 0").groupBy("c").agg(F.min("id").alias("least")))
    joined = member.where("n > 0").join(least, "c").select("id", "n", "least")
    alone = member.where("n = 0").select("id", "n", F.col("id").alias("least"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))
