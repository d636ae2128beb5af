"""Latency and throughput of a run, from its output rows ``ad_id, event_ts, process_ts, final_ts, row_count`` (times in ms)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two streams; a row lies in five windows.
STREAMS, WINDOWS_PER_ROW = 2, 5
#: Two-sided 95 % quantiles of Student's t by degrees of freedom, 1 to 10. Fixed values.
T_QUANTILES = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228)
#: The normal quantile, to which they fall.
Z_QUANTILE = 1.959963984540054


#: The first window of a run whose output names none; and limits, in ms, of the distance between rows of one window and of the next.
#: Fixed values.
FIRST_WINDOW, SAME_MS, LOW_MS, HIGH_MS = 5, 100, 900, 1100


def with_elapsed(results: DataFrame) -> DataFrame:
    """Without ad 0; ``elapsed`` is ms since the first event. The first event is one number, found by an aggregate."""
    rows = results.where("ad_id <> 0")
    first = rows.agg(F.min("event_ts").alias("_first"))
    return rows.join(F.broadcast(first)).withColumn("elapsed", F.col("final_ts") - F.col("_first")).drop("_first")  # one row


def with_latency(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_latency", F.col("final_ts") - F.col("event_ts")).withColumn("processing_latency", F.col("final_ts") - F.col("process_ts"))


def min_latency(rows: DataFrame, *by: str) -> DataFrame:
    """Least latencies by elapsed time, or by the window's columns."""
    return with_latency(rows).groupBy(*by).agg(F.min("event_latency").alias("event_latency"), F.min("processing_latency").alias("processing_latency"))


def tuples(rows_in_windows: Column) -> Column:
    """Input rows of both streams from rows counted in every window."""
    return rows_in_windows * STREAMS / WINDOWS_PER_ROW


def throughput_buckets(rows: DataFrame, bucket_ms: int = 1000) -> DataFrame:
    return rows.groupBy((F.col("elapsed") - F.col("elapsed") % bucket_ms).alias("bucket")).agg(tuples(F.sum("row_count")).alias("throughput"))


def throughput_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(tuples(F.sum("row_count")).alias("throughput"))


def runtime(rows: DataFrame) -> DataFrame:
    """Seconds from the first event to the last result."""
    return rows.agg(((F.max("final_ts") - F.min("event_ts")) / 1000).alias("seconds"))


def average_throughput(rows: DataFrame) -> DataFrame:
    """Input rows a second."""
    return rows.agg((tuples(F.sum("row_count")) * 1000 / (F.max("final_ts") - F.min("event_ts"))).alias("throughput"))


def t_quantile(df: Column) -> Column:
    """By degrees of freedom, null for less than 1: the table, and beyond it the Cornish-Fisher series, which is off by less than 0.00001."""
    z, v = Z_QUANTILE, df.cast("double")
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    series = F.lit(z)
    for k, term in enumerate(terms, 1):
        series = series + term / F.pow(v, F.lit(k))
    return F.when(df <= len(T_QUANTILES), F.get(F.array(*map(F.lit, T_QUANTILES)), (df - 1).cast("int"))).otherwise(series)


def mean_ci95(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """``mean`` and ``half_width`` of the 95 % confidence interval, over any number of runs; null for one run."""
    n = F.count(value)
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n) * t_quantile(n - 1)).alias("half_width"))


def ideal_scaling(means: DataFrame, nodes: str = "nodes", mean: str = "mean") -> DataFrame:
    """Adds what the run on one node would take on n: its mean over n."""
    one = means.where(F.col(nodes) == 1).agg(F.first(mean).alias("_one"))
    return means.join(F.broadcast(one)).withColumn("ideal", F.col("_one") / F.col(nodes)).drop("_one")  # one row


def after_warm_up(rows: DataFrame, ms: int = 4000) -> DataFrame:
    """Rows processed over ``ms`` after the first."""
    first = rows.agg((F.min("process_ts") + ms).alias("_from"))
    return rows.join(F.broadcast(first)).where(F.col("process_ts") > F.col("_from")).drop("_from")  # one row


def detect_windows(rows: DataFrame, run: str, order: str, first: int = FIRST_WINDOW) -> DataFrame:
    """``window`` of each row of a run, where the output names none: a new one begins when an ad comes again. Runs are folded in order,
    each in one task."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "ad_id"], kind="stable")
        window, seen, out = first, set(), []
        for ad in pdf["ad_id"]:
            if ad in seen:
                window, seen = window + 1, set()
            seen.add(ad)
            out.append(window)
        return pdf.assign(window=out)

    return rows.groupBy(run).applyInPandas(fold, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", window int")


def row_deltas(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``delta`` to the row before, inside each group."""
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equal as multisets."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def delta_faults(rows: list[tuple[int, int]], same_ms: int = SAME_MS, low_ms: int = LOW_MS, high_ms: int = HIGH_MS) -> Iterator[int]:
    """Positions of (window, export time) rows whose distance to the row before is wrong for the same or the next window."""
    for k in range(1, len(rows)):
        delta = rows[k][1] - rows[k - 1][1]
        if not (abs(delta) < same_ms if rows[k][0] == rows[k - 1][0] else low_ms < delta < high_ms):
            yield k
