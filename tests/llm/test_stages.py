"""What each stage of the pipeline keeps, against brute force on a small table with every kind of copy."""

import random
import re

import pytest
from test_edges import brute_lines, sentence, shingled

import corpus_pipeline
from askframe.llm import linededup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed string, row int"


@pytest.fixture(scope="module")
def rows(spark, folder):
    rng = random.Random(21)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").limit(3).collect()]
    given = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    base = [sentence(rng, n) for n in (40, 60, 90)]
    near = []
    for text in base:
        for _ in range(12):
            words = text.split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(30)}"
            near.append(" ".join(words))
    texts = [None, "", " ", "word", *given, *near, *(f"{base[0]} {x} {base[1]}" for x in items), f"{base[2]}\nown line {sentence(rng, 9)}"]
    out = [(i, t, "en", None if i % 5 == 0 else "s", None if t is None else len(t), f"r{i}", i) for i, t in enumerate(texts)]
    return [*out, out[70], (out[71][0], out[71][1], "de", "other", 1, "a", 2), (None, texts[72], None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(found, wanted):
    order = lambda r: str(tuple(r))
    assert sorted(map(tuple, found), key=order) == sorted(map(tuple, wanted), key=order)


def test_toxicity(spark, rows, folder):
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    wanted = [r for r in rows if model.scores([r[1] or ""])[0] < corpus_pipeline.TOXIC]
    same(corpus_pipeline.drop_toxic(spark, docs, folder).collect(), wanted)


def test_line_dedup(spark, rows, folder):
    left = {(k[1], k[2]): v for k, v in brute_lines([r for r in rows if r[0] is not None], linededup.MIN_WORDS).items()}
    wanted = []
    for r in rows:
        if r[0] is None:
            continue
        text = left.get((r[0], r[1]), r[1])
        changed = text != r[1]
        if not changed or text.replace("\n", " ").strip(" "):
            wanted.append((r[0], text, *r[2:4], len(text) if changed else r[4], *r[5:]))
    docs = frame(spark, [r for r in rows if r[0] is not None])
    found = corpus_pipeline.drop_repeated_lines(spark, docs, folder)
    assert found.columns == docs.columns
    same(found.collect(), wanted)


def test_ngram_jaccard(spark, rows, folder):
    docs = {}
    for r in rows:  # rows equal in id and text are one document
        docs.setdefault((r[0], r[1] or ""), []).append(r)
    keys, sets = list(docs), [shingled(t, 5) for _, t in docs]
    top = list(range(len(keys)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).append(k)
    found = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), folder).collect()
    first = lambda group: min(k[0] for k in group if k[0] is not None) if all(k[0] is not None for k in group) else None
    assert sorted(str(r.doc_id) for r in found) == sorted(str(first(g)) for g in groups.values())
    assert {r.row for r in found if r.doc_id == rows[71][0]} <= {71, 2}


def test_decontamination(spark, rows, folder):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    items = [runs(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    wanted = [r for r in rows if not any(x and 100 * len(x & runs(r[1])) >= 80 * len(x) for x in items)]
    assert len(wanted) < len(rows)
    same(corpus_pipeline.drop_contaminated(spark, frame(spark, rows), folder).collect(), wanted)


def test_tokens(spark, rows, folder):
    import public_tokenizers

    from askframe.llm import bpe

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = corpus_pipeline.tokenize(spark, frame(spark, rows), folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(r[0]), len(enc.encode_ordinary(r[1] or ""))) for r in rows)
    assert all(r.round_trip for r in found)
