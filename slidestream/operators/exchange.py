"""Distribution of rows and union of partitioned inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidestream.shared import cut


def hash_partition(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of a key in one of ``n`` partitions; any type of key, negative ones included."""
    return df.repartition(n, *keys)


def union_ranks(parts: list[DataFrame]) -> DataFrame:
    """One stream from the streams of several ranks."""
    if not parts:
        raise ValueError("no inputs")
    return reduce(DataFrame.unionByName, parts)


def in_rank(df: DataFrame, key: str, rank: int, size: int) -> DataFrame:
    """The rows that a rank of ``size`` owns."""
    return df.where(f"pmod({key}, {size}) = {rank}")


def with_positions(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``position``, from 0, in the order of the columns. Rows are dealt out by range and numbered inside each partition; what goes
    through one task is a count for each partition."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(bases), "_part").withColumn("position", F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")
