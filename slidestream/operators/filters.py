"""Filters: drop what a condition holds for, or keep it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidestream.fields import Field
from slidestream.functions.scalar import translated


def drop_if(df: DataFrame, field: Field | str, suffix: str) -> DataFrame:
    """Drops rows for which ``<field> <suffix>`` is true; rows where it is null stay."""
    name = field.column if isinstance(field, Field) else field
    return df.where(~F.coalesce(F.expr(translated(f"`{name}` {suffix}")), F.lit(False)))


def keep_if(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Keeps rows for which the predicate is true."""
    return df.where(translated(predicate) if isinstance(predicate, str) else predicate)
