"""Inner joins of windowed results, and of plain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidestream.fields import Field
from slidestream.operators.windows import END, START, WINDOW


def window_join(left: DataFrame, right: DataFrame, left_key: Field | str, right_key: Field | str) -> DataFrame:
    """Rows of the same window and key; the right side's key and window go. Both sides are partitioned by window and key already if they
    were aggregated by them, so no further exchange is planned."""
    l, r = (k.column if isinstance(k, Field) else k for k in (left_key, right_key))
    if l != r:
        right = right.withColumnRenamed(r, l)
    if WINDOW in left.columns and WINDOW in right.columns:
        return left.join(right.drop(START, END), [WINDOW, l], "inner").drop(WINDOW)
    return left.join(right.drop(END), [START, l], "inner")


def multi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Every pair of rows with equal keys; Spark picks the strategy by size, and splits skewed partitions."""
    return left.join(right, F.col(left_key) == F.col(right_key), "inner")


def of_latest(left_time: Column, right_time: Column, left: Column, right: Column) -> Column:
    """The value of the side whose time is later; of the right side if they are equal."""
    return F.when(left_time > right_time, left).otherwise(right)
