"""Quality rules: base counts of words, symbols and repeats, and compression bands.

The verdict compares zstandard ratios (compressed bytes over bytes) of the whole text and of fixed chunks with a band that depends on
length: below it the text repeats itself, above it the text is close to random. Longer stretches compress better, so limits fall with
length; between the listed lengths they are linear in log2(bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidestream.llm.common import arrow_map, texts

LEVEL = 3
CHUNK_BYTES = 2048
#: log2(bytes), lowest and highest ratio of prose.
BAND = ((6, 0.50, 1.20), (7, 0.52, 1.00), (8, 0.52, 0.90), (9, 0.50, 0.82), (10, 0.475, 0.76), (11, 0.455, 0.70), (12, 0.435, 0.66), (13, 0.415, 0.64), (14, 0.395, 0.62), (15, 0.38, 0.60), (16, 0.37, 0.60), (20, 0.33, 0.60))
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_AT, _LOW, _HIGH = (np.array(x) for x in zip(*BAND))


def limits(n_bytes: int) -> tuple[float, float]:
    at = np.log2(max(1, n_bytes))
    return float(np.interp(at, _AT, _LOW)), float(np.interp(at, _AT, _HIGH))


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    """Stretches of ``size`` bytes; a rest of less than half a chunk goes to the one before. One chunk is the whole text: none."""
    starts = list(range(0, len(data), size))
    if len(starts) > 1 and len(data) - starts[-1] < size // 2:
        starts.pop()
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])] if len(starts) > 1 else []


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter([index.setdefault(w, len(index)) for w in words], np.int64, n)
    pair = ids[:-1] * len(index) + ids[1:]
    if len(index) > 2_000_000:  # else three ids fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, counts = np.unique(pair[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= again
    return int(mark.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8").split()
    with_words = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(with_words) - len(set(with_words)), repeat_words(words)


def compression(text: str, compressor: zstandard.ZstdCompressor) -> tuple[float, float, float, bool]:
    """Ratio of the whole, least and greatest ratio of the chunks (the whole's if there are none), and whether all are in the band."""
    data = text.encode("utf-8")
    if not data:
        return 0.0, 0.0, 0.0, False
    rows = [(len(compressor.compress(x)) / len(x), *limits(len(x))) for x in (data, *chunks(data))]
    parts = [r for r, _, _ in rows[1:]] or [rows[0][0]]
    return rows[0][0], min(parts), max(parts), all(low <= r <= high for r, low, high in rows)


def quality(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, chunk_low, chunk_high)`` of each row.

    A null or empty text has no words, ratios of 0, and isn't kept. Repeated rows give repeated results; other columns are ignored; an
    empty table gives no rows. Texts of any length are compressed whole.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for b in batches:
            rows = [(*base_counts(t), *compression(t, compressor)) for t in texts(b.column(1))]
            n, chars, symbols, lines, repeats, whole, low, high, inside = (np.array(c) for c in zip(*rows)) if rows else [np.zeros(0)] * 9
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            columns = [pa.array(c.astype(np.int64)) for c in (n, chars, symbols, lines, repeats)] + [pa.array(failed.astype(bool)), pa.array((~failed.astype(bool)) & inside.astype(bool))] + [pa.array(c.astype(np.float64)) for c in (whole, low, high)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *names, "base_failed", "kept", "ratio", "chunk_low", "chunk_high"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double")
