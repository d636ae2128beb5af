"""Inputs of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidestream.functions.scalar import split_tokens


def constants(spark: SparkSession, values: Iterable, kind: str = "int") -> DataFrame:
    """In-memory values as column ``value``; no values give no rows."""
    return spark.createDataFrame([(v,) for v in values], f"value {kind}")


def tokens(spark: SparkSession, stream: TextIO | None = None, kind: str = "string") -> DataFrame:
    """White-space separated tokens of standard input (or another text stream), cast to ``kind``."""
    found = [(t,) for t in (stream or sys.stdin).read().split()]
    return spark.createDataFrame(found, "value string").select(F.col("value").try_cast(kind).alias("value"))


def file_tokens(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated tokens of text files."""
    return spark.read.text(path).select(F.explode(split_tokens(F.col("value"))).alias("value"))


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``value``, unparsed."""
    return spark.read.text(path)


def config(spark: SparkSession, path: str) -> dict[str, float]:
    """A header and one line of numbers."""
    row = spark.read.option("header", True).csv(path).first()
    return {k: float(v) for k, v in row.asDict().items()}


def json_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of text ``{"key", "value", "ts"}``, numbers in quotes: key string, value int, ts long (ms since 1970)."""
    parsed = F.from_json(value, T.StructType([T.StructField(n, T.StringType()) for n in ("key", "value", "ts")]))
    return lines.select(parsed.alias("e")).select("e.key", F.col("e.value").try_cast("int").alias("value"), F.col("e.ts").try_cast("long").alias("ts"))
