"""Exact removal of repeated byte strings by sampled suffixes.

A difference cover guarantees that two equal strings hold sampled positions at the same offset. Here the sample is taken
by content, which does the same with far fewer positions: of every ``SPAN`` neighbouring positions, the one whose next
``GRAM`` bytes have the smallest hash. SPAN + GRAM - 1 bytes fit into a string of the length looked for, so equal strings
choose the same offset, and a string is known by its sampled suffix and what stands before that.

1. Sampled positions are named by their next GRAM bytes, and names that occur once drop out.
2. The strings that chose one sampled position are neighbours, so all of them together are one run of bytes around it.
   Runs are named as a whole; where one occurs again, so do all of its strings.
3. A run that occurs once can still share some strings with another run of its name. Only there is it taken apart, into
   pieces of PIECE neighbouring strings, which are named as a whole and by the bytes that all of their strings share.
4. Only pieces that occur once and whose shared bytes occur elsewhere are taken apart into strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.llm.common import Scratch, cut, slices

#: Bytes of the strings that must not repeat; of what a sampled position is named by; positions that one is sampled of.
LENGTH, GRAM, SPAN = 200, 64, 128
#: Strings of a piece.
PIECE = 16
#: Bytes looked at at a time, which bounds memory however long a text is.
BLOCK = 1 << 20
#: Least and most bits of the filters for names and places, which get eight for each. They come to the driver and go to
#: all executors, so their size is bounded; a false bit costs time, never a result.
BITS = (1 << 16, 1 << 29)
_LOW = np.uint64((1 << 24) - 1)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling; shorter by GRAM - 1."""
    out = _BYTES[data]
    for step, multiplier in enumerate(_MULTIPLIERS):
        size = 1 << step
        out = out[:-size] * multiplier + out[size:]
        if step in (2, 5):
            out = _mix(out)
    return out


def sampled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the strings of LENGTH bytes in ``data``: sampled positions, their names, first and last string of each."""
    hashes = grams(data)
    strings = len(data) - LENGTH + 1
    low = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)  # of equal ones the first
    size = 1
    while size < SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    at = (low[:strings] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], strings] - 1
    places = at[first]
    return places, hashes[places].view(np.int64), first, last


def _blocks(data: np.ndarray, block: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, max(0, len(data) - LENGTH + 1), block):
        yield start, data[start : start + block + LENGTH - 1]


def _names(block: int):
    """The names of sampled positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for text in batch.column(0):
                for _, part in _blocks(np.frombuffer(text.as_buffer(), np.uint8), block):
                    found.append(sampled(part)[1])
                if sum(map(len, found[-64:])) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["name"])
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["name"])

    return run


def _shown(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the filter holds each of some numbers."""
    slot = numbers.astype(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _places(doc: int, at: np.ndarray) -> np.ndarray:
    """Numbers that stand for places of a document in a filter."""
    return _mix(np.full(len(at), doc & (2**64 - 1), np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """128-bit digests as two columns of numbers, which take less room and sort faster than bytes."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _rows_of(batch: pa.RecordBatch, rows: list[int]) -> list[pa.Array]:
    """Id and text hash of the given rows."""
    at = pa.array(rows, pa.int64())
    return [batch.column(0).take(at), batch.column(1).take(at)]


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text, 512)


def _runs_in(text: pa.Scalar, bits: np.ndarray, block: int) -> Iterator[tuple[memoryview, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of a text whose name may repeat: its bytes from an offset, that offset, names, places, both ends."""
    for start, part in _blocks(np.frombuffer(text.as_buffer(), np.uint8), block):
        places, names, first, last = sampled(part)
        hit = np.flatnonzero(_shown(bits, names))
        yield memoryview(part), start, names[hit], places[hit], first[hit], last[hit]


def _runs(shared, block: int):
    """Name, hash of the run with the offset in it, document, first string, and that place's number.

    The first string tells runs of a text apart: where a block ends, two of them can have one sampled position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in _slices(batches, 2):
            rows, digests, numbers = [], [], [[np.zeros(0, np.int64)] for _ in range(3)]
            for row, (doc, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2), strict=True)):
                for data, start, names, places, first, last in _runs_in(text, bits, block):
                    for p, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True):
                        digests.append(xxhash.xxh3_128_digest(data[a : b + LENGTH], seed=p - a))
                    rows += [row] * len(names)
                    for column, values in zip(numbers, (names, first + start, _places(doc, first + start)), strict=True):
                        column.append(values)
            name, at, number = (pa.array(np.concatenate(x)) for x in numbers)
            columns = [name, *_halves(digests), *_rows_of(batch, rows), at, number]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "r1", "r2", "id", "h", "s", "place"])

    return run


def _pieces_in(text: pa.Scalar, doc: int, bits: np.ndarray, apart: np.ndarray, block: int) -> Iterator[tuple[memoryview, int, int, int, int, int]]:
    """Pieces of the runs whose first string is in ``apart``: bytes, their offset, number in the run, top, first and last string.

    Piece j has the strings that begin PIECE * j to PIECE * j + PIECE - 1 before the sampled position, or those of them
    that the run has.
    """
    for data, start, _, places, first, last in _runs_in(text, bits, block):
        hit = _shown(apart, _places(doc, first + start))
        for s, a, b in zip(places[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
            for j in range((s - b) // PIECE, (s - a) // PIECE + 1):
                top = s - PIECE * j
                yield data, start, j, top, max(a, top - PIECE + 1), min(b, top)


def _pieces(shared, block: int):
    """Hash of the bytes that all strings of a piece share, even where a run lacks some; of the piece; document, ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, apart = (np.frombuffer(x, np.uint8) for x in shared.value)
        for batch in _slices(batches, 2):
            rows, core, whole, first, last, places = [], [], [], [], [], [np.zeros(0, np.int64)]
            for row, (doc, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2), strict=True)):
                begun = len(first)
                for data, start, j, top, u, v in _pieces_in(text, doc, bits, apart, block):
                    core.append(xxhash.xxh3_128_digest(data[top : top + LENGTH - PIECE + 1], seed=j))
                    whole.append(xxhash.xxh3_128_digest(data[u : v + LENGTH], seed=top - u))
                    first.append(u + start)
                    last.append(v + start)
                rows += [row] * (len(first) - begun)
                places.append(_places(doc, np.array(first[begun:], np.int64)))
            columns = [*_halves(core), *_halves(whole), *_rows_of(batch, rows), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(np.concatenate(places))]
            yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "w1", "w2", "id", "h", "a", "b", "place"])

    return run


def _strings(shared, block: int):
    """Each string of the pieces at some places, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, apart, again = (np.frombuffer(x, np.uint8) for x in shared.value)
        for batch in _slices(batches, 2):
            rows, digests, at = [], [], []
            for row, (doc, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2), strict=True)):
                begun, found = len(at), [(data, start, u, v) for data, start, _, _, u, v in _pieces_in(text, doc, bits, apart, block)]
                hit = _shown(again, _places(doc, np.array([start + u for _, start, u, _ in found], np.int64)))
                for i in np.flatnonzero(hit).tolist():
                    data, start, u, v = found[i]
                    digests += [xxhash.xxh3_128_digest(data[p : p + LENGTH]) for p in range(u, v + 1)]
                    at += range(u + start, v + start + 1)
                rows += [row] * (len(at) - begun)
            yield pa.RecordBatch.from_arrays([*_halves(digests), *_rows_of(batch, rows), pa.array(at, pa.int64())], names=["s1", "s2", "id", "h", "p"])

    return run


def _touched(keep: bool, shared):
    """The texts with a run in ``shared``'s filter of documents, or those without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            hit = _shown(docs, batch.column(3).to_numpy())
            yield batch.filter(pa.array(hit if keep else ~hit))

    return run


def _take_out(shared, block: int):
    """What is left of each text once the strings of its repeated runs, and the others listed, are taken out.

    ``single`` lists the first strings of the runs that occur once; the other runs of the text are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in _slices(batches, 1):
            kept, all_spans = [], []
            for text, single, places in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data, once = text.as_py(), set(single.as_py() or [])
                found = [(r["a"], r["b"]) for r in places.as_py() or []]
                for _, start, _, _, first, last in _runs_in(text, bits, block):
                    found += [(a + start, b + start) for a, b in zip(first.tolist(), last.tolist(), strict=True) if a + start not in once]
                spans: list[dict[str, int]] = []
                for a, b in sorted(found):
                    if spans and a <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], b + LENGTH)
                    else:
                        spans.append({"start": a, "end": b + LENGTH})
                ends = [0, *(s["end"] for s in spans)]
                kept.append(b"".join(data[x:y] for x, y in zip(ends, [*(s["start"] for s in spans), len(data)], strict=True)))
                all_spans.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(all_spans, kind)], names=["id", "kept", "spans"])

    return run


def _bits(numbers: DataFrame) -> bytes:
    """The filter of a table with one column of numbers as bytes: a bit for the slot of each."""
    size = min(max(BITS[0], 1 << (8 * numbers.count()).bit_length()), BITS[1])
    slot = F.col(numbers.columns[0]).bitwiseAND(size - 1) + 1  # Spark's bitmaps count from 1
    made = numbers.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    rows = made.toArrow()
    for bucket, bits in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def _counted(df: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Rows by ``keys`` with their number and one of them. All that is picked is numbers, so nothing needs a sort."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in kept])


def _open(counted: DataFrame, keys: list[str], scratch: Scratch) -> bytes:
    """The filter of places of rows counted by more than ``keys`` whose keys have several, one with a single occurrence."""
    several = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("several"), F.min("n").alias("least"))
    wanted = scratch.cut(several.where("several > 1 and least = 1").select(*keys))
    places = scratch.cut(counted.join(wanted, keys, "left_semi").select("place"))
    bits = _bits(places)
    scratch.drop(wanted, places)
    return bits


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Each row's id with ``n_bytes``, ``kept`` (the bytes left) and ``spans`` (start and end of what was removed).

    A byte goes if a string of LENGTH bytes over it also starts anywhere else: in another row or at another place of the
    same one, overlapping or not. Strings are judged on the texts as given. Null and empty texts, and those shorter than
    LENGTH bytes, lose nothing. Repeated rows are other places, so both lose what is long enough, and so do rows with
    equal ids. A null id stays null; other columns are ignored; an empty table gives an empty result. ``block`` bytes are
    looked at at a time; it changes no result.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), _text(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    texts = source.where(F.octet_length("t") >= LENGTH).select("id", "h", "t", F.xxhash64("id", "h").alias("doc"))
    context, key = spark.sparkContext, texts.schema["id"]

    def scan(make, filters, before: str, after: str) -> DataFrame:
        """One pass over the texts. What a filter lets through by mistake is a real place, so it does no harm."""
        numbers = lambda names: [T.StructField(x, T.LongType()) for x in names.split()]
        out = T.StructType([*numbers(before), T.StructField("id", key.dataType), *numbers(after)])
        return texts.mapInArrow(make(context.broadcast(filters), block), out)

    scratch = Scratch(spark)
    names = scratch.cut(texts.select("t").mapInArrow(_names(block), "name bigint").groupBy("name").count().where("count > 1").select("name"))
    repeated = _bits(names)
    scratch.drop(names)
    runs = scratch.cut(scan(_runs, repeated, "name r1 r2", "h a place"))
    same = scratch.cut(_counted(runs, ["name", "r1", "r2"], ["id", "h", "a", "place"]))
    held = scratch.cut(runs.select(F.xxhash64("id", "h").alias("doc")).distinct())
    docs = context.broadcast(_bits(held))
    scratch.drop(runs, held)
    # of names with several runs, one of which occurs once, one place of each run is taken apart
    apart = _open(same, ["name"], scratch)
    single = scratch.cut(same.where("n = 1").groupBy("id", "h").agg(F.collect_set("a").alias("single")))
    scratch.drop(same)
    pieces = scratch.cut(scan(_pieces, (repeated, apart), "c1 c2 w1 w2", "h a b place"))
    alike = scratch.cut(_counted(pieces, ["c1", "c2", "w1", "w2"], ["place"]))
    again = _open(alike, ["c1", "c2"], scratch)
    # read twice: another pass over the texts costs less than keeping a row for each string
    strings = scan(_strings, (repeated, apart, again), "s1 s2", "h p")

    def twice(counted: DataFrame, keys: list[str]) -> DataFrame:
        return scratch.cut(counted.where("n > 1").select(*keys))

    of_string = ["s1", "s2"]
    by_string = strings.join(twice(_counted(strings, of_string, []), of_string), of_string).select("id", "h", F.col("p").alias("a"), F.col("p").alias("b"))
    of_piece = ["c1", "c2", "w1", "w2"]
    by_piece = pieces.join(twice(alike, of_piece), of_piece).select("id", "h", "a", "b")
    places = by_piece.unionByName(by_string).groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("places"))
    listed = single.join(places, single["h"].eqNullSafe(places["h"]) & single["id"].eqNullSafe(places["id"]), "full")
    listed = cut(listed.select(F.coalesce(single["id"], places["id"]).alias("id_"), F.coalesce(single["h"], places["h"]).alias("h_"), "single", "places"))
    scratch.close()
    # only texts with a run that may repeat have to meet their lists; the others stay where they are
    every = source.select("id", "h", "t", F.xxhash64("id", "h").alias("doc"))
    some = every.mapInArrow(_touched(True, docs), every.schema)
    joined = some.join(listed, some["h"].eqNullSafe(listed["h_"]) & some["id"].eqNullSafe(listed["id_"]), "left").select("id", "t", "single", "places")
    rest = T._parse_datatype_string("kept binary, spans array<struct<start: bigint, end: bigint>>")
    done = joined.mapInArrow(_take_out(context.broadcast(repeated), block), T.StructType([key, *rest.fields]))
    free = every.mapInArrow(_touched(False, docs), every.schema)
    free = free.select("id", F.octet_length("t").cast("long").alias("n_bytes"), F.col("t").alias("kept"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    done = done.select("id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), "kept", "spans").unionByName(free)
    return done.withColumnRenamed("id", id_col)
