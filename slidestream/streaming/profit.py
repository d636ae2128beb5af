"""The profit of ads over a stream of events, without a join of streams.

Both sides are one stream, so one aggregation by pane and ad holds all state, and the join is a filter on windows of panes. A row is in one
pane, not in every window that holds it; a watermark drops a pane's state once no event can reach it any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slidestream.plans.profit import profit_of_panes, side_totals
from slidestream.shared import new_folder

#: How far events may come behind the latest one. Later ones don't count.
LATENESS = "2 days"


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def instant(local: Column) -> Column:
    """A time without zone as one in UTC, whatever the session's zone: watermarks need an instant."""
    return F.timestamp_micros(((local - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long"))


def local(at: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(secs=(F.unix_micros(at).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))


def paned(sides: DataFrame, slide: int, lateness: str = LATENESS) -> DataFrame:
    """Of ``ts, ad_id, cost, value``, streaming: totals by pane and ad."""
    zoneless = sides.schema["ts"].dataType == T.TimestampNTZType()
    at = sides.withColumn("_at", instant(F.col("ts")) if zoneless else F.col("ts")).withWatermark("_at", lateness)
    out = at.groupBy(F.window("_at", f"{slide} milliseconds"), "ad_id").agg(*side_totals())
    pane = F.col("window.start")
    return out.select((local(pane) if zoneless else pane).alias("pane"), "ad_id", "cost", "value", "max_ts", "n_ads", "n_checkouts")


def start(sides: DataFrame, slide: int, folder: str, lateness: str = LATENESS) -> StreamingQuery:
    """Each micro-batch appends the panes that it changed, marked with its number; a repeated batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/n={number}")

    return paned(sides, slide, lateness).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, size: int, slide: int) -> DataFrame:
    """Each window and ad that has both sides, by the last state of its panes: ``w_start, ad_id, profit, max_ts, n_ads``."""
    last = spark.read.parquet(f"{folder}/rows").groupBy("pane", "ad_id").agg(F.max_by(F.struct("cost", "value", "max_ts", "n_ads", "n_checkouts"), "batch").alias("s"))
    return profit_of_panes(last.select("pane", "ad_id", "s.*"), size, slide)


def run(sides: DataFrame, size: int, slide: int, lateness: str = LATENESS) -> DataFrame:
    """Runs the stream over what its source has now. Its folder, below the shared one, stays until the caller deletes it."""
    spark = sides.sparkSession
    folder = new_folder(spark, "profit")
    start(sides, slide, folder, lateness).awaitTermination()
    return latest(spark, folder, size, slide)
