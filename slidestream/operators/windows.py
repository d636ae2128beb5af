"""Tumbling and sliding windows, and sliding aggregation by panes.

Spark plans ``window(ts, size, slide)`` with size/slide copies of each input row. Pane aggregation first reduces rows to one for each key
and slide, and only these are copied into the windows that hold the slide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidestream.fields import AggSchema
from slidestream.operators.aggregate import aggregate, expressions

START, END, WINDOW = "w_start", "w_end", "window"


def check(size: int, slide: int) -> int:
    """Slides of a window; the size must be a multiple of the slide."""
    if slide <= 0 or size <= 0 or size % slide:
        raise ValueError(f"a window of {size} ms isn't a multiple of its slide of {slide} ms")
    return size // slide


def _ms(n: int) -> str:
    return f"{n} milliseconds"


def sliding(df: DataFrame, ts: str, size: int, slide: int, offset: int = 0) -> DataFrame:
    """Each row once for each window that holds it, with ``w_start`` and ``w_end``. Windows are aligned with the epoch plus ``offset`` ms."""
    check(size, slide)
    w = F.window(ts, _ms(size), _ms(slide), _ms(offset)) if slide != size or offset else F.window(ts, _ms(size))
    return df.withColumn("_w", w).withColumn(START, F.col("_w.start")).withColumn(END, F.col("_w.end")).drop("_w")


def tumbling(df: DataFrame, ts: str, size: int) -> DataFrame:
    return sliding(df, ts, size, size)


def sliding_aggregate(df: DataFrame, ts: str, size: int, slide: int, spec: AggSchema, arrival: str | None = None) -> DataFrame:
    """Directly: for streams, and as the check of the pane plan. A stream keeps the column ``window``, which carries its watermark."""
    if not df.isStreaming:
        return aggregate(sliding(df, ts, size, slide), spec, [START, END], arrival)
    check(size, slide)
    out = aggregate(df.withColumn(WINDOW, F.window(ts, _ms(size), _ms(slide))), spec, [WINDOW], arrival)
    return out.withColumn(START, F.col(f"{WINDOW}.start")).withColumn(END, F.col(f"{WINDOW}.end"))


def windows_of_pane(pane: Column, size: int, slide: int) -> Column:
    """Starts of the windows that hold a pane, as rows."""
    return F.explode(F.array(*[pane - F.expr(f"INTERVAL {k * slide * 1000} MICROSECONDS") for k in range(check(size, slide))]))


def pane_aggregate(df: DataFrame, ts: str, size: int, slide: int, spec: AggSchema, arrival: str | None = None) -> DataFrame:
    """The same rows as ``sliding_aggregate``: panes first, then windows of panes. All kinds merge; ``noop`` by its first arrival."""
    check(size, slide)
    keys = [f.column for f in spec.keys()]
    first = [F.min(arrival).alias("_arrival")] if arrival else []
    panes = df.withColumn("_pane", F.window(ts, _ms(slide)).start).groupBy("_pane", *keys).agg(*expressions(spec, arrival), *first)
    copies = panes.withColumn(START, windows_of_pane(F.col("_pane"), size, slide))
    out = copies.groupBy(START, *keys).agg(*(expressions(spec, "_arrival" if arrival else None) or [F.count("*").alias("_rows")]))
    return out.withColumn(END, F.col(START) + F.expr(f"INTERVAL {size * 1000} MICROSECONDS"))
