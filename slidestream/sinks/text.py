"""Rows as text, and where it goes."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FRACTIONS = {"double", "float"}


def lines(df: DataFrame, separator: str = ",", places: int = 6) -> DataFrame:
    """One ``value`` for each row: columns in order, fractions with six decimals."""
    cells = [F.format_string(f"%.{places}f", F.col(c).cast("double")) if t in FRACTIONS or t.startswith("decimal") else F.col(c).cast("string") for c, t in df.dtypes]
    return df.select(F.concat_ws(separator, *[F.coalesce(c, F.lit("")) for c in cells]).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Replaces the folder by text files without header, one for each partition."""
    lines(df).write.mode("overwrite").text(path)


def to_console(df: DataFrame, out: TextIO | None = None) -> int:
    """Prints rows, fetched a partition at a time; returns their number."""
    n = 0
    for row in lines(df).toLocalIterator():
        print(row.value, file=out or sys.stdout)
        n += 1
    return n


def to_console_vectors(df: DataFrame, column: str, out: TextIO | None = None, first_only: bool = False) -> int:
    """Prints arrays as space-separated lines, up to the first empty one; of structs all fields, or the first."""
    n = 0
    for row in df.select(column).toLocalIterator():
        if not row[0]:
            break
        print(" ".join(str(x[0] if first_only else ",".join(map(str, x)) if isinstance(x, tuple) else x) for x in row[0]), file=out or sys.stdout)
        n += 1
    return n


def to_function(df: DataFrame, n: int, fn: Callable[[int, Any], None]) -> None:
    """Calls ``fn(i, row)`` for the first n rows, i from 1."""
    for i, row in enumerate(df.limit(n).toLocalIterator(), 1):
        fn(i, row)


def stream_csv(df: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Appends text files; exactly once, by the sink's own log."""
    return lines(df).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def stream_console(df: DataFrame, mode: str = "append", **trigger: Any) -> StreamingQuery:
    return df.writeStream.format("console").option("truncate", False).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()


def stream_memory(df: DataFrame, name: str, mode: str = "append", **trigger: Any) -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()


def stream_function(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger: Any) -> StreamingQuery:
    """Calls ``fn(batch, number)`` for each micro-batch. A repeated batch has the same number."""
    return df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
