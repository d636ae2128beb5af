"""Columns added to rows, and functions over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidestream.fields import Field
from slidestream.functions.scalar import Strategy, now_millis, translated


def append(df: DataFrame, new: Field, expression: str) -> DataFrame:
    """A column from a SQL expression, cast to the field's type."""
    return df.withColumn(new.column, F.expr(translated(expression)).cast(new.spark_type))


def append_timestamp(df: DataFrame, new: Field) -> DataFrame:
    """Wall-clock milliseconds; the same for all rows of a batch or micro-batch."""
    return df.withColumn(new.column, now_millis().cast(new.spark_type))


def combine(df: DataFrame, new: Field, left: Field, right: Field, strategy: Strategy) -> DataFrame:
    return df.withColumn(new.column, strategy(F.col(left.column), F.col(right.column)).cast(new.spark_type))


def map_columns(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()])


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function that Spark can't see into, over Arrow batches. Prefer ``map_columns``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(fn, batches)

    return df.mapInPandas(run, schema)


def project(df: DataFrame, *fields: Field, names: bool = True) -> DataFrame:
    """The fields in this order, under their plain names."""
    return df.select(*[F.col(f.column).alias(f.name if names else f.column) for f in fields])
