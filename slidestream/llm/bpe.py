"""Byte-level BPE with the tiktoken library and a local rank file.

A long text is cut where no match of the pattern can cross: before a space or line feed that follows a character which is not white
space. No alternative of the pattern matches such a pair of characters inside, and none looks behind, so the parts' ids in a row are the
text's ids.

A long run of white space is one match of the pattern, less its last character where something follows. The library's pattern engine
keeps a state for each of its characters and gives up at a million, so such a run is merged as one piece without the pattern.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidestream.llm.common import arrow_map, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points from which a text is cut into parts.
LONG_CHARS = 1 << 16
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
#: From so many characters a run of white space bypasses the pattern.
RUN_CHARS = 1 << 12
#: Unicode's White_Space, which is what the pattern takes for \\s. Fixed values.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN_CHARS)


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """One per worker process and rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long_chars: int = LONG_CHARS) -> Iterator[str]:
    """The text in parts of about ``long_chars``, cut at safe boundaries only (so a part may be longer)."""
    at = 0
    while len(text) - at > long_chars:
        cut = _BOUNDARY.search(text, at + long_chars)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_part(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text, its long runs of white space as pieces of their own."""
    if len(text) < RUN_CHARS:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))  # what follows takes the last one, or matches without it
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def encode(text: str, path: str, long_chars: int = LONG_CHARS) -> np.ndarray:
    """uint32 ids, without special tokens."""
    enc = encoding(path)
    if len(text) <= long_chars:
        return np.array(encode_part(enc, text), np.uint32)
    return np.concatenate([np.array(encode_part(enc, p), np.uint32) for p in parts(text, long_chars)])


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes of the ids in a row; they need not be valid UTF-8."""
    return encoding(path).decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)``; ids are little-endian uint32 bytes.

    Null and empty texts have no ids; a null doc_id stays null; repeated rows give repeated results; other columns are ignored; an empty
    table gives no rows. Texts of any length are encoded whole.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t, path) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``(doc_id, text_bytes)`` of ``encode_documents``'s result.

    Null and empty ids give no bytes; repeated rows give repeated results; other columns are ignored; an empty table gives no rows. An id
    that the rank file doesn't have is an error of the library.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode(np.frombuffer(x or b"", "<u4"), path) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "text_bytes"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, its ids decoded, digests of both.

    Null and empty texts have no ids and the digests of no bytes; repeated rows give repeated results; extra columns are ignored; an
    empty table gives no rows. Texts of any length are encoded whole, in parts that meet at safe boundaries.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in texts(b.column(1)):
                ids = encode(t, path)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(decode(ids, path)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
