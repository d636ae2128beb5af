"""Grouped aggregation by an aggregation schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidestream.fields import AggSchema


def expressions(spec: AggSchema, arrival: str | None = None) -> list[Column]:
    """``noop`` is the value that arrived first; without an arrival column any one of the group."""
    out = []
    for f, kind in spec.values():
        c = F.col(f.column)
        if kind == "noop":
            out.append((F.min_by(c, F.col(arrival)) if arrival else F.first(c)).alias(f.column))
        else:
            out.append({"sum": F.sum, "min": F.min, "max": F.max}[kind](c).cast(f.spark_type).alias(f.column))
    return out


def aggregate(df: DataFrame, spec: AggSchema, by: list[str] | None = None, arrival: str | None = None) -> DataFrame:
    """Groups by the keys and by columns ``by`` (a window, say). Spark aggregates before and after one exchange."""
    keys = [F.col(f.column) for f in spec.keys()]
    return df.groupBy(*[F.col(b) for b in by or []], *keys).agg(*(expressions(spec, arrival) or [F.count("*").alias("_rows")]))
