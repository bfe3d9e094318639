"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is cut at safe boundaries before it is handed to the library.  Between an alphanumeric character and an ASCII
space or newline a match of the split pattern always ends: no alternative crosses from a non-space to a space, none
looks behind, and the only look-ahead belongs to space runs.  Runs of white space longer than ``LONG_RUN`` overflow
the library's regex stack, so they are encoded as the one piece the pattern makes of them.

Null or empty text: no tokens.  Repeated rows and null ids: one output row per input row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import each_text

#: Characters handed to the library at once, and the white-space run that it never sees.
CHUNK_CHARS, LONG_RUN = 32_768, 2_048

_WHITE = "\t-\r \x85\xa0  -     　"
_LONG_WHITE = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")
_BOUNDARY = re.compile(r"(?<=[^\W_])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file (base64 token and rank on each line); cached in each worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK_CHARS) -> Iterator[tuple[str, bool]]:
    """(part, is one piece): parts that can be encoded on their own, in order."""
    at = 0
    for run in _LONG_WHITE.finditer(text):
        last = run.end() == len(text)
        end = run.end() if last else run.end() - 1  # the last one goes with what follows
        yield from ((part, False) for part in _chunks(text[at : run.start()], chunk))
        yield text[run.start() : end], True
        at = end
    yield from ((part, False) for part in _chunks(text[at:], chunk))


def _chunks(text: str, chunk: int) -> Iterator[str]:
    at = 0
    while len(text) - at > chunk:
        cut = _BOUNDARY.search(text, at + chunk)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, whole in pieces(text):
        ids += enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)
    return ids


def _mapped(docs: DataFrame, rank_file: str, pattern: str, schema: str, row, id_col: str, text_col: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def work(doc_ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        out: list[list] = [[] for _ in names[1:]]
        for t in texts:
            for column, value in zip(out, row(enc, t.as_py()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, out)], names)

    return each_text(docs, schema, work, id_col, text_col)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text."""

    def row(enc, text: str):
        return (np.asarray(encode_text(enc, text), dtype=np.int32),)

    return _mapped(docs, rank_file, pattern, "doc_id long, ids array<int>", row, id_col, text_col)


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of each id list; null ids give null bytes."""
    from pyspark.sql import functions as F

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in it:
            raw = [None if ids is None else enc.decode_bytes(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(batches, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, then decoded, in one pass."""

    def row(enc, text: str):
        ids = encode_text(enc, text)
        packed = np.asarray(ids, dtype="<u4").tobytes()
        return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()

    return _mapped(docs, rank_file, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row, id_col, text_col)
