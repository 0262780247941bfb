"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from askframe.llm.common import map_texts

#: A place where every pattern that keeps white space at the front of a match must start a new match: white space
#: after something that is none. Texts may be cut there without changing a single token.
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: Characters after which a long text is cut at the next safe place.
CHUNK = 1 << 16


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (a line holds a base64 token and its rank), once per Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """``text`` in pieces of about ``size`` characters, cut at safe places only; one piece if there are none."""
    pieces, start = [], 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if found is None:
            break
        pieces.append(text[start : found.start()])
        start = found.start()
    pieces.append(text[start:])
    return pieces


def encode(text: str, enc: tiktoken.Encoding, size: int = CHUNK) -> list[int]:
    """Token ids of a whole text, without special tokens; equal to encoding it in one piece."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in chunks(text, size) for i in enc.encode_ordinary(piece)]


def coder(rank_file: str, pattern: str) -> Callable[[list[str]], list[pa.Array]]:
    """A function from texts to arrays of ids and of the bytes that the ids decode to."""

    def run(texts: list[str]) -> list[pa.Array]:
        enc = encoding(rank_file, pattern)
        ids = [encode(t, enc) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())]

    return run


def encode_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with ``token_ids`` (array of int) and ``decoded`` (raw bytes of those ids).

    One pass without a shuffle; a text is never cut where that could change a token. Null and empty texts give no
    ids and no bytes. Repeated rows and ids are each encoded; a null id stays null; columns besides the two named are
    ignored; an empty table gives an empty result. ``rank_file`` must exist at that path on every executor.
    """
    return map_texts(df, id_col, text_col, "token_ids array<int>, decoded binary", coder(rank_file, pattern))
