"""The profit of ads: two streams, sliding windows of five slides, joined by window and ad.

Ads cost, checkouts bring value; checkouts without an ad (id 0) are dropped. For every window and ad with both: value less cost, the
latest event and processing times, the number of ads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidestream.fields import AggSchema, Field, Schema
from slidestream.functions.scalar import diff, greater, money
from slidestream.operators.windows import windows_of_pane
from slidestream.plans import dsl

SLIDE_MS, SLIDES = 1000, 5
Source = Callable[[SparkSession], DataFrame]
#: Columns of the two wire formats, in order. Fixed values.
AD_LINE = (("ad_id", "int"), ("user_id", "int"), ("amount", "double"), ("event_ts", "uint64"))
CHECKOUT_LINE = (("purchase_id", "int"), ("user_id", "int"), ("ad_id", "int"), ("amount", "double"), ("event_ts", "uint64"))


@dataclass(frozen=True)
class ProfitQuery:
    """The query's pipeline up to its sink, and the fields it puts out."""

    joined: dsl.Pipeline
    output: tuple[Field, ...]


@dataclass(frozen=True)
class Side:
    """One stream by window and ad: its amount added up, latest times, and how many rows it had."""

    pipeline: dsl.Pipeline
    ad: Field
    amount: Field
    event: Field
    processed: Field
    rows: Field

    @classmethod
    def of(cls, read: Source, line: tuple[tuple[str, str], ...], without_ad: bool, windowed: Callable[[AggSchema], dsl.Op]) -> Side:
        fields = {name: Field(name, kind) for name, kind in line}
        ad, amount, event = (fields[n] for n in ("ad_id", "amount", "event_ts"))
        processed, rows = Field("process_ts", "uint64"), Field("row_count", "uint64")
        parsed = dsl.source(read) | dsl.parse_lines(Schema.of(*fields.values()))
        kept = parsed if without_ad else parsed | dsl.drop_if(ad, "== 0")
        totals = AggSchema.of((ad, "key"), (amount, "sum"), (event, "max"), (processed, "max"), (rows, "sum"))
        return cls(kept | dsl.append_timestamp(processed) | dsl.append(rows, "1") | windowed(totals), ad, amount, event, processed, rows)


def profit_query(ads: Source, checkouts: Source, slide_ms: int = SLIDE_MS, slides: int = SLIDES, watermark: str | None = None, panes: bool = False) -> ProfitQuery:
    """The query over two sources of lines with arrival times, batch or streaming. Output: ad_id, profit, event_ts, process_ts, final_ts,
    row_count."""
    windowed = lambda totals: dsl.sliding_aggregate(slide_ms, slides, totals, watermark, panes)
    cost, value = Side.of(ads, AD_LINE, True, windowed), Side.of(checkouts, CHECKOUT_LINE, False, windowed)
    pipeline = dsl.hash_join(cost.pipeline, value.pipeline, cost.ad, value.ad)
    out = [cost.ad]
    for name, kind, pair, strategy in (("profit", "double", (value.amount, cost.amount), diff), ("event_ts", "uint64", (cost.event, value.event), greater), ("process_ts", "uint64", (cost.processed, value.processed), greater)):
        out.append(Field(name, kind))
        pipeline = pipeline | dsl.combine(out[-1], *pair, strategy)
    final = Field("final_ts", "uint64")
    return ProfitQuery(pipeline | dsl.append_timestamp(final), (*out, final, cost.rows))


def profit_by_window(ads: DataFrame, checkouts: DataFrame, size: int, slide: int) -> DataFrame:
    """The query over columns ``ts, ad_id, amount`` of both sides: ``w_start, ad_id, profit, max_ts, n_ads``."""
    none = F.lit(None).cast("double")
    return profit_of_sides(ads.select("ts", "ad_id", F.col("amount").alias("cost"), none.alias("value")).union(checkouts.where("ad_id <> 0").select("ts", "ad_id", none, "amount")), size, slide)


def side_totals() -> list:
    """Of rows ``ts, cost, value``: exact sums, the latest time of a row that counts, and how many each side had."""
    counted = F.when(F.col("cost").isNotNull() | F.col("value").isNotNull(), F.col("ts"))
    return [F.sum(money(F.col("cost"))).alias("cost"), F.sum(money(F.col("value"))).alias("value"), F.max(counted).alias("max_ts"), F.count("cost").alias("n_ads"), F.count("value").alias("n_checkouts")]


def profit_of_panes(panes: DataFrame, size: int, slide: int) -> DataFrame:
    """The query over ``pane, ad_id`` and ``side_totals``, one row for each pane and ad."""
    copies = panes.withColumn("w_start", windows_of_pane(F.col("pane"), size, slide))
    return (
        copies.groupBy("w_start", "ad_id")
        .agg(F.sum("cost").alias("cost"), F.sum("value").alias("value"), F.max("max_ts").alias("max_ts"), F.sum("n_ads").alias("n_ads"), F.sum("n_checkouts").alias("n_checkouts"))
        .where("n_ads > 0 AND n_checkouts > 0")
        .select("w_start", "ad_id", (F.col("value") - F.col("cost")).cast("double").alias("profit"), "max_ts", "n_ads")
    )


def profit_of_sides(rows: DataFrame, size: int, slide: int) -> DataFrame:
    """The query over ``ts, ad_id, cost, value``: an ad has a cost, a checkout a value, no row both; rows with neither don't count.

    One plan for both sides: their panes are aggregated together, so rows are exchanged once by pane and key and once, already reduced to
    a row for each pane and key, by window and key, and the join is a filter on the groups. Amounts are added exactly.
    """
    panes = rows.groupBy(F.window("ts", f"{slide} milliseconds").start.alias("pane"), "ad_id").agg(*side_totals())
    return profit_of_panes(panes, size, slide)
