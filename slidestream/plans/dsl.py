"""Pipelines written with ``|``: a source, operators, a sink.

An operator is a function from DataFrame to DataFrame and from schema to schema; a pipeline checks schemas as it is put together and has
no plan of its own. Applying it gives a DataFrame, which Spark optimises as a whole. The same pipeline runs over a batch or a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidestream.fields import AggSchema, Field, Schema
from slidestream.functions.scalar import Strategy
from slidestream.operators import filters, joins, parse, project, windows
from slidestream.sinks import text

ARRIVAL = "arrival"


@dataclass(frozen=True)
class Op:
    """``columns``: schema after the operator; ``apply``: the rows; ``keeps_arrival``: whether arrival times go on."""

    name: str
    columns: Callable[[Schema | None], Schema | None]
    apply: Callable[[DataFrame], DataFrame]

    def __or__(self, other: Op | Sink) -> Any:
        return Pipeline((self,)) | other


@dataclass(frozen=True)
class Sink:
    name: str
    run: Callable[[DataFrame, Schema | None], Any]


@dataclass(frozen=True)
class Pipeline:
    """Operators in order. ``source`` gives lines with ``value`` and ``arrival``."""

    ops: tuple[Op, ...] = ()
    source: Callable[[SparkSession], DataFrame] | None = None
    schema: Schema | None = None

    def __or__(self, other: Op | Sink | Pipeline) -> Any:
        if isinstance(other, Sink):
            return Runnable(self, other)
        if isinstance(other, Pipeline):
            if other.source:
                raise ValueError("a source can only stand first")
            out = self
            for op in other.ops:
                out = out | op
            return out
        schema = other.columns(self.schema) if self.source else None
        return replace(self, ops=(*self.ops, other), schema=schema)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        if not self.source:
            raise ValueError("a pipeline needs a source")
        df = self.source(spark)
        for op in self.ops:
            df = op.apply(df)
        return df


@dataclass(frozen=True)
class Runnable:
    """A pipeline with its sink; ``run`` starts it."""

    pipeline: Pipeline
    sink: Sink

    def run(self, spark: SparkSession) -> Any:
        return self.sink.run(self.pipeline.dataframe(spark), self.pipeline.schema)


def source(read: Callable[[SparkSession], DataFrame]) -> Pipeline:
    """Lines from any of ``slidestream.sources``."""
    return Pipeline(source=read, schema=Schema.of())


def parse_lines(schema: Schema) -> Op:
    return Op("parse", lambda _: schema, lambda df: parse.accepted(parse.parse_csv(df, schema)))


def _needs(schema: Schema | None, *fields: Field) -> Schema:
    if schema is None:
        raise ValueError("an operator stands before its source")
    schema.require(*fields)
    return schema


def append(new: Field, expression: str) -> Op:
    return Op("append", lambda s: _needs(s).plus(new), lambda df: project.append(df, new, expression))


def append_timestamp(new: Field) -> Op:
    return Op("append_timestamp", lambda s: _needs(s).plus(new), lambda df: project.append_timestamp(df, new))


def combine(new: Field, left: Field, right: Field, strategy: Strategy) -> Op:
    return Op("combine", lambda s: _needs(s, left, right).plus(new), lambda df: project.combine(df, new, left, right, strategy))


def drop_if(f: Field, suffix: str) -> Op:
    return Op("filter", lambda s: _needs(s, f), lambda df: filters.drop_if(df, f, suffix))


def sliding_aggregate(slide_ms: int, slides: int, spec: AggSchema, watermark: str | None = None, panes: bool = False) -> Op:
    """Sliding windows over arrival times. ``panes`` is for batches only; a stream needs a watermark to close windows."""

    def run(df: DataFrame) -> DataFrame:
        if df.isStreaming:
            df = df.withWatermark(ARRIVAL, watermark) if watermark else df
            return windows.sliding_aggregate(df, ARRIVAL, slides * slide_ms, slide_ms, spec, ARRIVAL)
        return (windows.pane_aggregate if panes else windows.sliding_aggregate)(df, ARRIVAL, slides * slide_ms, slide_ms, spec, ARRIVAL)

    return Op("sliding_aggregate", lambda s: (_needs(s, *spec.schema()), spec.schema())[1], run)


def hash_join(left: Pipeline, right: Pipeline, left_key: Field, right_key: Field) -> Pipeline:
    """Windowed results of two pipelines, joined by window and key."""
    if left.schema is None or right.schema is None:
        raise ValueError("both sides of a join need a source")
    left.schema.require(left_key)
    right.schema.require(right_key)
    rest = [f for f in right.schema if f is not right_key]
    return Pipeline(source=lambda spark: joins.window_join(left.dataframe(spark), right.dataframe(spark), left_key, right_key), schema=left.schema.plus(*rest))


def file_output(path: str, *fields: Field) -> Sink:
    return Sink("file", lambda df, s: (_needs(s, *fields), text.write_csv(project.project(df, *fields), path))[1])


def console_output(*fields: Field) -> Sink:
    return Sink("console", lambda df, s: (_needs(s, *fields), text.to_console(project.project(df, *fields)))[1])


def function_output(n: int, fn: Callable[[int, Any], None], *fields: Field) -> Sink:
    return Sink("function", lambda df, s: (_needs(s, *fields), text.to_function(project.project(df, *fields), n, fn))[1])


def stream_output(path: str, checkpoint: str, *fields: Field) -> Sink:
    return Sink("stream", lambda df, s: (_needs(s, *fields), text.stream_csv(project.project(df, *fields), path, checkpoint))[1])


def rows_output(*fields: Field) -> Sink:
    """The DataFrame of the fields and the window's bounds, not yet computed."""
    return Sink("rows", lambda df, s: (_needs(s, *fields), df.select(*[F.col(c) for c in (windows.START,) if c in df.columns], *[F.col(f.column).alias(f.name) for f in fields]))[1])
