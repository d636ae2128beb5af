"""Files replayed as a stream, one at a time, oldest first."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_slides(folder: str, lines: Iterable[str], burst: int, start_ms: int, slide_ms: int, flush: tuple[int, str] | None = None) -> None:
    """One file for each burst of lines: ``arrival ms|line``. Files get modification times a slide apart, as the source orders by them.

    ``flush`` adds a last line, with its arrival in ms. It must parse, and be of a key that doesn't matter: it lets the watermark pass
    every window before.
    """
    os.makedirs(folder, exist_ok=True)
    rest, n = list(lines), 0
    bursts = [rest[k : k + burst] for k in range(0, len(rest), burst)]
    stamped = [[f"{start_ms + k * slide_ms}|{x}" for x in b] for k, b in enumerate(bursts)] + ([[f"{flush[0]}|{flush[1]}"]] if flush else [])
    for n, b in enumerate(stamped):
        path = f"{folder}/{n:06d}.txt"
        with open(path, "w") as f:
            f.write("".join(f"{x}\n" for x in b))
        os.utime(path, (1_600_000_000 + n, 1_600_000_000 + n))


def replayed(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """``value`` and ``arrival`` of stamped lines, streaming."""
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).format("text").load(folder)
    return stamped(raw)


def stamped(raw: DataFrame) -> DataFrame:
    parts = F.split("value", r"\|", 2)
    return raw.select(parts[1].alias("value"), F.timestamp_millis(parts[0].cast("long")).alias("arrival"))
