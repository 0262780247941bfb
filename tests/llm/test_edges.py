"""Every operator on the cases that break operators: nulls, empty and long texts, repeats, no rows, clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from askframe.llm import bpe, chat, components, decontam, licenses, linededup, media, ngramjoin, pii, queries, suffixdedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 60, 90, 200, 400)]
    passage = sentence(rng, 70)
    texts = [None, "", " \n\t ", "word", "one two three", *base]
    texts += [base[2], base[2], base[2] + " extra", base[3].replace("alpha", "omega", 1), "x " * 40000, "y" * 70000]
    texts += [f"{base[1]}\n{passage}\n{base[0]}", f"{passage}\nother", f"start\n\n{passage}", f"{passage}\n{passage}"]
    texts += ["mail a.b@ex.org or c at ex dot org, +1 (555) 123-4567, 4111 1111 1111 1111, 10.1.2.3 and 300.1.1.1", "É é ß 漢字 \U0001f600 \x00 \x1f"]
    out = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[6], (None, base[1], None, None, None), (7, "another text under a used id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # more columns, with names that operators use inside
    more = ["k", "t", "key", "id", "h", "node", "n", "_i", "_lines", "_h", "spans", "score", "x", "u", "v", "n_lines", "n_removed"]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(1).alias(c) for c in more])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows, found):
    """Results beside the texts of their ids, for ids with one text."""
    times = Counter(r[0] for r in rows)
    return [(r[1], found[r[0]]) for r in rows if times[r[0]] == 1 and r[0] is not None]


def test_bpe(docs, rows, nothing):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    out = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    for text, (ids, data) in by_text(rows, {r.doc_id: (r.token_ids, bytes(r.decoded)) for r in out}):
        assert ids == enc.encode_ordinary(text or "") and data == (text or "").encode()
    assert bpe.encode_decode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_cuts_change_nothing():
    enc, rng = bpe.encoding(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Z", "9", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "é", "漢", "!", " ", " ", "\x1c", "\x85", " don't"]) for _ in range(80))
        assert bpe.encode(text, enc, 5) == enc.encode_ordinary(text)


def test_media(docs, rows, nothing, spark):
    out = media.texts_as_media(docs, form="bmp").collect()
    assert len(out) == len(rows)
    for text, r in by_text(rows, {r.doc_id: r for r in out}):
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert bytes(r.samples) == padded and media.decode(bytes(r.media)).tobytes() == padded and len(r.dhash) == 16
    assert media.texts_as_media(nothing).count() == 0
    bad = spark.createDataFrame([(1, b"P5 2 2 255 "), (2, None), (3, b"what"), (4, b"BM")], "i int, m binary")
    assert all(r.height is None for r in media.decode_media(bad, "i", "m").collect())


def test_image_formats():
    rng = np.random.default_rng(2)
    grey = rng.integers(0, 256, (5, 7), np.uint8)
    assert (media.decode(media.to_pgm(grey))[:, :, 0] == grey).all() and (media.decode(media.to_bmp(grey))[:, :, 0] == grey).all()
    assert (media.decode(b"P2 # c\n2 1\n# d\n255 7 9")[:, :, 0] == [[7, 9]]).all()
    assert (media.decode(b"P1 3 1 1 0 1")[:, :, 0] == [[0, 255, 0]]).all()
    assert (media.decode(b"P4 3 1\n" + bytes([0b10100000]))[:, :, 0] == [[0, 255, 0]]).all()
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[[255]]]
    big = rng.integers(0, 256, (12, 18, 1), np.uint8)
    assert np.allclose(media.area_resize(big, 4, 6), big.reshape(4, 3, 6, 3, 1).mean((1, 3)))
    assert np.isclose(media.area_resize(big, 5, 7).mean(), big.mean())


def slow_pii(text):
    spans = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                spans.append((kind, *m.span()))
    return spans


def test_pii_equals_the_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "b-c", "1", "12", "255", "256", "+1", " ", "-", "(", ")", "4111111111111111", "é", "x@y.z", "%", "0"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(25))
        assert pii.detect(text) == slow_pii(text), text
        assert [s[:3] for s in pii.find(text) if s[3]] == slow_pii(text)


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to john.doe at example dot com now", "john.doe at example dot com"),
        ("x[at]y(dot)org", "x[at]y(dot)org"),
        ("jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("call +1 five five five one two three four five six seven", "+1 five five five one two three four five six seven"),
        ("a＠b．com", "a＠b．com"),
    ],
)
def test_disguises(text, found):
    assert [text[s:e] for _, s, e, base in pii.find(text) if not base] == [found]


def test_pii_frame(docs, rows, nothing):
    out = pii.find_pii(docs).collect()
    assert len(out) == len(rows)
    for text, spans in by_text(rows, {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in out}):
        assert spans == slow_pii(text or "")
    assert pii.find_pii(nothing).count() == 0


def brute_lines(rows, w):
    docs = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0], d[1]))
    full = {d: [(i, x) for i, x in enumerate(d[2].split("\n")) if x.strip(" \t")] for d in docs}
    first, gone = {}, {d: set() for d in docs}
    for d in docs:
        for s in range(len(full[d])):
            for e in range(s, len(full[d])):
                run = tuple(x for _, x in full[d][s : e + 1])
                if sum(len([y for y in re.split(r"[ \t]+", x) if y]) for x in run) >= w:
                    if run in first:
                        gone[d].update(i for i, _ in full[d][s : e + 1])
                    first.setdefault(run, (d, s))
    return {d: "\n".join(x for i, x in enumerate(d[2].split("\n")) if i not in gone[d]) for d in docs}


def test_line_dedup(spark, docs, rows, nothing):
    out = linededup.dedup_lines(docs)
    assert out.columns.count("n_removed") == 1 and set(docs.columns) == set(out.columns)
    unique = [r for r in rows if r[0] != 7]
    wanted = {k[1]: v for k, v in brute_lines(unique, linededup.MIN_WORDS).items() if not k[0]}
    found = {r.doc_id: r.text for r in linededup.dedup_lines(docs.where("doc_id != 7 or doc_id is null")).collect() if r.doc_id is not None}
    assert {k: found[k] for k in wanted} == wanted
    assert out.count() == len(rows) and out.where("text is null and n_lines = 0").count() == 1
    assert linededup.dedup_lines(nothing).count() == 0


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b c", "d", "", "e f g", "        return x", "\t", " \t d"]) for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    found = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {k[1]: v for k, v in brute_lines(rows, linededup.MIN_WORDS).items()}


def brute_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        end = 0
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                low = max(i, end)
                gone[low : i + length] = b"\1" * (i + length - low)
                end = i + length
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g))
    return out


def test_suffix_dedup(spark, docs, rows, nothing):
    out = suffixdedup.remove_repeats(docs).collect()
    wanted = brute_bytes([r[1] for r in rows], suffixdedup.LENGTH)
    assert Counter((r.doc_id, bytes(r.kept)) for r in out) == Counter((r[0], w) for r, w in zip(rows, wanted, strict=True))
    assert all(r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans) for r in out)
    assert suffixdedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_of_edited_copies(spark):
    rng = random.Random(4)
    base = [sentence(rng, 120) for _ in range(4)]
    texts = []
    for _ in range(40):
        text = rng.choice(base)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "é", "zz", base[0][:210], "ab" * 150]) + text[at + rng.randrange(3) :]
        texts.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: bytes(r.kept) for r in suffixdedup.remove_repeats(df).collect()}
    assert [found[i] for i in range(len(texts))] == brute_bytes(texts, suffixdedup.LENGTH)


def shingled(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_links(rows, n, percent):
    sets = [shingled(r[1], n) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def test_ngram_join(docs, rows, nothing):
    out = ngramjoin.link(docs).collect()
    assert Counter(tuple(r) for r in out) == brute_links(rows, 4, 85)
    assert ngramjoin.link(nothing).count() == 0


def test_ngram_join_of_a_large_group(spark):
    rng = random.Random(6)
    base, rows = sentence(rng, 80).split(), []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 9])):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(60)}"
        rows.append((i, " ".join(words[: rng.choice([80, 80, 70])])))
    rows += [(1000 + i, "a b c " + rng.choice("pqr")) for i in range(20)]
    out = ngramjoin.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(tuple(r) for r in out) == brute_links(rows, 4, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_decontamination(spark, docs, rows, nothing):
    words = lambda t: [w for w in re.findall(r"[^\W_]+", (t or "").lower())]
    texts = {r[0]: r[1] for r in rows}
    lines = texts[8].split(" ")
    items = [(1, " ".join(lines[20:60])), (2, " ".join(lines[:10]) + " not in any text at all here now"), (3, "too short"), (4, None), (5, ""), (None, " ".join(lines[100:130])), (1, " ".join(lines[20:60]))]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, n int")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    wanted = set()
    for doc, *rest in rows:
        said = words(rest[0])
        have = {tuple(said[i : i + 5]) for i in range(len(said) - 4)}
        for item, text in items:
            need = {tuple(words(text)[i : i + 5]) for i in range(len(words(text)) - 4)}
            if need and 100 * len(need & have) >= 80 * len(need):
                wanted.add((doc, item))
    assert found == wanted and (8, 1) in found and (8, None) in found
    assert decontam.find_leaks(nothing, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_licenses(spark, nothing):
    mit = licenses.TEMPLATES[0][1]
    rows = [(1, f"code\nReleased under the MIT License.\nmore"), (2, mit), (3, mit.replace("software", "program")), (4, None), (5, ""), (6, "license"), (7, "Nothing here. Licensed under the Apache License, Version 2.0. Really."), (None, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1, "MIT"] == got[2, "MIT"] == got[7, "Apache-2.0"] == got[None, "CC-BY-NC-4.0"] == 1.0
    assert 0.8 <= got[3, "MIT"] < 1.0 and not {4, 5, 6} & {k[0] for k in got}
    assert licenses.scan_licenses(nothing).count() == 0 and licenses.scan_licenses(nothing, templates=()).count() == 0


def test_chat(spark):
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":{"y":2,"x":1}},{"id":"b","name":"f","arguments":"{\\"x\\":\\"s\\"}"},{"id":"c","name":"g"}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id":"a","content":"early"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"zz"}'), (None, None, None, None), (1, 0, "user", "hi"), (2, 1, "assistant", "{bad"), (2, 2, "user", '{"tool_calls":[]}')]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("uid", F.lit(1)).withColumn("key", F.lit(2))
    schema = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": {"type": "number"}}
    out = chat.format_chats(df, {"f": schema}).orderBy("conv_id", "order_turn", "order_rank", "turn").collect()
    assert len(out) == len(rows)
    made = next(r for r in out if r.n_calls)
    assert (made.n_calls, made.n_invalid, made.n_answered) == (3, 2, 1) and '"arguments":{"x":1,"y":2}' in made.json
    results = [r for r in out if r.role == "tool"]
    assert [(r.turn, r.order_turn, r.order_rank, r.n_orphans) for r in results] == [(1, 2, 1, 0), (3, 3, 1, 1)]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_json_schemas():
    assert not chat.problems([1, 2], {"type": "array", "items": {"type": "integer"}, "maxItems": 2})
    assert chat.problems("abc", {"type": "string", "maxLength": 2}) and chat.problems(True, {"type": "integer"})
    assert chat.problems(1, {"oneOf": [{"type": "integer"}, {"minimum": 0}]}) and not chat.problems(1, {"anyOf": [{"const": 1}, False]})
    assert chat.problems({"a": 1}, {"additionalProperties": False}) and chat.problems(2, {"not": {"enum": [2]}})


def test_toxicity(spark, docs, rows, nothing):
    rng = random.Random(9)
    texts = []
    for i in range(600):
        toxic = rng.random() < 0.3
        words = sentence(rng, rng.randrange(5, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "skrunz" + rng.choice(["a", "el", "ion", "os"]), "you moron"]))
        texts.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(None, 1), (3, None)], "doc_id bigint, toxic int").where("not (doc_id = 3 and toxic is null)")
    model = toxicity.fit(df, labels)
    held = df.where(toxicity.remainder("doc_id") == 1)
    found = {r.doc_id: r.score for r in toxicity.score(held, model).collect()}
    right = sum((found[i] >= 0.7) == bool(y) for i, _, y in texts if i in found)
    assert right / len(found) > 0.95 and all(0 <= s <= 1 for s in found.values())
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(nothing, toxicity.fit(df, none)).count() == 0
    x = np.linspace(0, 1, 50)[:, None]
    trees = toxicity.fit_trees(x, (x[:, 0] > 0.5).astype(float))
    assert ((trees.margin(x) > 0) == (x[:, 0] > 0.5)).all()
    steps = toxicity.fit_isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(steps(np.linspace(-1, 4, 30))) >= 0).all()


def test_pipeline_stages(spark, docs, folder):
    shown = docs.select(*[x.split()[0] for x in SCHEMA.split(", ")])
    for _, stage in corpus_pipeline.STAGES:
        columns = shown.columns
        kept = stage(spark, shown, folder)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert kept.columns == columns
            shown = spark.createDataFrame(kept.collect(), kept.schema)
    out = kept.collect()
    assert all(r.round_trip for r in out) and 0 < len(out) < docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_pipeline_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.where("not round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, folder, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = queries.queries()[name](spark, folder)
    result = connection.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    columns = sorted(df.columns)
    wanted = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns and sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == wanted


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_suffix_dedup", "op8_ngram_jaccard", "op9_media_columns", "op10_pii", "op4_byte_bpe"])
def test_contract_columns(spark, folder, name):
    df = queries.queries()[name](spark, folder)
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())


def test_digests(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id bigint, text string")
    path = spark.sparkContext.getCheckpointDir() + "/digests"
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_byte_bpe(spark, path).collect()}
    ids = bpe.encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary("Hello world")
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[2].n_tokens == 0
    assert got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    seen = {r.doc_id: r for r in queries.op9_media_columns(spark, path).collect()}
    assert (seen[2].n_bytes, seen[2].payload_bytes) == (0, 64) and seen[1].tail_crc32 == __import__("zlib").crc32(b"Hello world".ljust(64, b"\0"))
