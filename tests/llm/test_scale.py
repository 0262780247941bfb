"""Blocks, bounds and times that hold however long a text or large a group is."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import brute_bytes, brute_links, sentence, shingled, slow_pii

from askframe.llm import bpe, media, ngramjoin, pii, queries, suffixdedup, toxicity
from askframe.llm.common import Scratch, slices

DOCUMENTS = "doc_id bigint, text string"


def written(spark, name, rows, schema=DOCUMENTS):
    """A folder with a table of documents, for queries."""
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return path


# what is cut at blocks


def test_suffix_dedup_at_block_ends(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        p = "".join(rng.choice("abcdefghij ") for _ in range(1500))
        texts += [p, p[: rng.choice([711, 700, 712, 513, 1023])]]
    df = spark.createDataFrame(list(enumerate(texts)), DOCUMENTS)
    wanted = brute_bytes(texts, suffixdedup.LENGTH)
    for block in (512, 700, 1 << 20):
        found = {r.doc_id: bytes(r.kept) for r in suffixdedup.remove_repeats(df, block=block).collect()}
        assert [found[i] for i in range(len(texts))] == wanted, block


def test_suffix_dedup_of_texts_beyond_a_block(spark):
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(suffixdedup.BLOCK + 5000))
    at = suffixdedup.BLOCK
    texts = [long, long[at - 300 : at + 250], long[at - 150 : at + 150], long[: at + 90], "other " + long[5:400]]
    path = written(spark, "long", list(enumerate(texts)))
    found = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, path).collect()}
    for i, kept in enumerate(brute_bytes(texts, suffixdedup.LENGTH)):
        assert found[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and found[i].n_removed == len(texts[i]) - len(kept)


def test_op3_columns(spark):
    rng = random.Random(13)
    base = [sentence(rng, 80) for _ in range(3)]
    texts = [None, "", *base, base[0] + " é " + base[1], "x" * 450, base[2][:260] + "…" + base[2][240:]]
    found = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, written(spark, "op3", list(enumerate(texts)))).collect()}
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    for i, d in enumerate(data):
        gone = {j for k in range(len(d) - 199) if counts[d[k : k + 200]] > 1 for j in range(k, k + 200)}
        kept = bytes(b for j, b in enumerate(d) if j not in gone)
        spans = sum(j in gone and j - 1 not in gone for j in range(len(d)))
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (len(d), len(gone), spans, hashlib.sha256(kept).hexdigest())


def test_words_hashed_in_blocks(monkeypatch):
    rng = random.Random(14)
    texts = ["".join(rng.choice(["a", "B", " ", "\t", "é", "word", "\n"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    whole = ngramjoin.Shingler(4)
    wanted = [whole(t) for t in texts]
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(ngramjoin, "_BLOCK", size)
        cut = ngramjoin.Shingler(4)
        assert all((cut(t) == w).all() for t, w in zip(texts, wanted, strict=True))
    assert [len(w) for w in wanted] == [len(shingled(t, 4)) for t in texts]


def test_resize_in_strips(monkeypatch):
    image = np.random.default_rng(3).integers(0, 256, (301, 37, 3), np.uint8)
    wanted = [media.area_resize(image, *size) for size in ((16, 16), (8, 9), (400, 5))]
    monkeypatch.setattr(media, "STRIP", 500)
    for size, whole in zip(((16, 16), (8, 9), (400, 5)), wanted, strict=True):
        assert np.array_equal(media.area_resize(image, *size), whole)


def test_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([*"abcdefg"]), pa.array(["x" * (9 << 20), None, "y", "z" * (9 << 20), "", "w" * (20 << 20), "v"])], names=["k", "t"])
    parts = [p.column(0).to_pylist() for p in slices(batch, 1, 3)]
    assert sum(parts, []) == [*"abcdefg"] and all(1 <= len(p) <= 3 for p in parts) and ["f"] in [p[-1:] for p in parts]


# PII


@pytest.mark.parametrize(
    "text",
    [
        "one two " + "1" * 10**6 + "x",
        "[" + " " * 10**6 + "one two",
        " " * 10**6 + "[at] one two",
        "one " * 10**5 + "onex",
        "one, 1 " * 10**5 + "z",
        "a at b dot " * 2 * 10**4,
        "1 dot " * 10**5,
        "a@" * 10**5,
        "+1" + "-" * 10**6,
        "plus " * 10**5,
    ],
)
def test_time_in_proportion(text):
    start = time.process_time()
    pii.find(text)
    assert time.process_time() - start < 20


class ByCharacter:
    """What Rewrite does, with the source's span of every character."""

    def __init__(self, text):
        self.text, self.spans = text, [(i, i + 1) for i in range(len(text))]

    def apply(self, edits):
        out, spans, at = "", [], 0
        for left, right, new in edits:
            out += self.text[at:left] + new
            spans += self.spans[at:left] + [(self.spans[left][0], self.spans[right - 1][1])] * len(new)
            at = right
        self.text, self.spans = out + self.text[at:], spans + self.spans[at:]

    def source(self, left, right):
        return self.spans[left][0], self.spans[right - 1][1]


def test_offsets_map_back():
    rng = random.Random(15)
    for _ in range(500):
        text = "".join(rng.choice("abcdef") for _ in range(40))
        fast, slow = pii.Rewrite(text), ByCharacter(text)
        for _ in range(rng.randrange(1, 5)):
            edits, at = [], 0
            while (left := at + rng.randrange(0, 8)) < len(fast.text) - 4:
                at = left + rng.randrange(1, 4)
                edits.append((left, at, rng.choice(["", "X", "YZ"])))
            fast.apply(iter(edits))
            slow.apply(edits)
            assert fast.text == slow.text
            for _ in range(20 if fast.text else 0):
                i = rng.randrange(len(fast.text))
                j = rng.randrange(i, len(fast.text)) + 1
                assert fast.source(i, j) == slow.source(i, j)


def test_op10_columns(spark, monkeypatch):
    rng = random.Random(16)
    parts = ["john", " at ", " dot ", "example", ".com", "[at]", "(dot)", "one ", "two ", "five ", "+1 ", "555", "4111 1111 1111 1111", "10.0.0.1", " ", "а", "ｅ", "\u200b", "x@y.zz", "192 dot 168 dot 0 dot 1"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(30)) for _ in range(400))]
    found = {r.doc_id: r for r in queries.op10_pii(spark, written(spark, "op10", list(enumerate(texts)))).collect()}
    monkeypatch.setattr(pii, "Rewrite", type("Slow", (ByCharacter,), {"steps": property(lambda self: self.spans != [(i, i + 1) for i in range(len(self.spans))])}))
    added = 0
    for i, text in enumerate(texts):
        base = slow_pii(text or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(base, key=lambda x: (pii.KINDS.index(x[0]), x[1])))
        assert found[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert found[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in pii.find(text or ""))
        added += found[i].n_added
    assert added > 100


# toxicity


def test_copies_of_a_labelled_row(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(i, sentence(rng, 20) + (" idiot moron" if i % 4 == 0 else "")) for i in range(400)]
    copies = [rows[8]] * 150 + [rows[9]] * 150
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] * 2, "doc_id bigint, toxic int")
    seen = []
    keep = toxicity.fit_trees
    monkeypatch.setattr(toxicity, "fit_trees", lambda x, y, **k: seen.append(len(y)) or keep(x, y, **k))
    plain = toxicity.fit(spark.createDataFrame(rows, DOCUMENTS), labels, fit_rows=100)
    many = toxicity.fit(spark.createDataFrame(rows + copies, DOCUMENTS).repartition(4), labels, fit_rows=100)
    assert seen[0] == seen[1] <= 100
    assert plain.lexicon.words == many.lexicon.words and plain.scores([r[1] for r in rows]).tolist() == many.scores([r[1] for r in rows]).tolist()


def test_held_out_scores(spark, folder):
    folder = folder.replace("0.001", "0.1")
    found = queries.op2_toxicity(spark, folder)
    joined = found.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    part = joined.groupBy("held_out").agg(F.avg((F.col("score") - F.col("toxic")) ** 2).alias("brier"), F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"))
    out = {r.held_out: r for r in part.collect()}
    assert out[True].right > 0.98 and out[True].brier < 0.01 and abs(out[True].brier - out[False].brier) < 0.005


# similarity joins


def test_links_of_given_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for n, percent in ((4, 85), (5, 80)):
        assert Counter(tuple(r) for r in ngramjoin.link(df, n=n, percent=percent).collect()) == brute_links(rows, n, percent)


def test_links_around_frequent_tokens(spark):
    rng = random.Random(18)
    common = sentence(rng, 30).split()
    rows = []
    for i in range(150):
        words = list(common[: rng.choice([12, 20, 30])])
        words[rng.randrange(len(words))] = f"own{rng.randrange(25)}"
        rows.append((i, " ".join([*words, *(f"tail{rng.randrange(3)}" for _ in range(rng.randrange(3)))])))
    df = spark.createDataFrame(rows, DOCUMENTS)
    for n, percent in ((4, 85), (5, 80), (1, 50)):
        assert Counter(tuple(r) for r in ngramjoin.link(df, n=n, percent=percent).collect()) == brute_links(rows, n, percent)


# the other queries of the contract


def test_op9_columns(spark):
    texts = [None, "", "a", "x" * 64, "é" * 70, "line\n" * 500]
    found = {r.doc_id: r for r in queries.op9_media_columns(spark, written(spark, "op9", list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(padded), len(stored))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(padded).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and re.fullmatch("[0-9a-f]{16}:[0-9a-f]{16}", r.feature)
    assert found[0].feature == found[1].feature


def test_op4_of_given_documents(spark, folder):
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op4_byte_bpe(spark, folder).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_scratch_leaves_nothing(spark):
    scratch = Scratch(spark)
    a, b = scratch.cut(spark.range(10)), scratch.cut(spark.range(5))
    assert (a.count(), b.count()) == (10, 5)
    scratch.keep(b)
    assert b.count() == 5 and len(scratch.paths) == 1
    scratch.close()
    assert not scratch.paths


def test_number_words_are_hinted_at_in_any_case():
    import re

    from askframe.llm import pii

    words = pii._WORDS
    whole = re.compile(rf"(?<!\w)(?:{words})[\s,.-]++(?:{words}|[0-9]++)(?!\w)", re.I)
    firsts = ["one", "xone", "One", "fıve", "SİX", "ſix", "FÜNF", "un", "_un", "éun"]
    for first in firsts:
        for gap in (" ", "", ", -", "x"):
            for second in ("two", "TWO", "12", "12a", "١", ""):
                for text in (first + gap + second, f"a {first}{gap}{second}.", f"{first}{gap}{second}{gap}three"):
                    assert pii._hints(text) == bool(whole.search(text)), text
