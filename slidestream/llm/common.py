"""What several corpus operators share: word and shingle arrays, and Arrow mapping.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` cuts at exactly that set, and
``bytes.lower()`` changes A-Z only, so both work on UTF-8 without decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from slidestream.shared import ship

#: Bytes of an Arrow batch that Spark hands to Python; a row larger than that is a batch of its own.
BYTES_PER_BATCH = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Entries that a worker's cache of words may hold before it starts anew.
CACHE_ENTRIES = 300_000


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded size. Spark reads the bound when the plan runs, so it is left in the session's settings;
    one that the caller has set stays."""
    ship(df.sparkSession)
    spark = df.sparkSession
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(BYTES_PER_BATCH))
    names = df.columns
    if not any(c in x for x in names for c in ".`"):
        return df.mapInArrow(fn, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*[f"_{k}" for k in range(len(names))]).mapInArrow(named, schema)  # Spark looks columns up by plain name


def quoted(column: str) -> str:
    """The name as a reference, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def lower_words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


class WordHashes(dict):
    """XXH64 of words, computed once for each while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers that make the hash of a shingle depend on word order.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words; of the whole sequence if it is shorter; none for no words."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(width, n)
    out = np.zeros(n - w + 1, np.uint64)
    for k in range(w):
        out += mixed(hashes[k : n - w + 1 + k] ^ _MULTIPLIERS[k]) * _MULTIPLIERS[k]
    return mixed(out)
