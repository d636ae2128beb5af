"""Generated ads and checkouts, and a server that sends lines at a pace."""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of the generated values, ints inclusive, amounts up to but without the end; and the seed. Fixed values.
AD_RANGES = {"ad_id": (1, 1000), "user_id": (0, 100), "cost": (10.0, 100.0)}
CHECKOUT_RANGES = {"purchase_id": (0, 10000), "ad_id": (0, 1000), "user_id": (0, 100), "value": (10.0, 100.0)}
SEED = 1531445423


def _whole(low: int, high: int, seed: int) -> Column:
    return (F.floor(F.rand(seed) * (int(high) - int(low) + 1)) + int(low)).cast("int")


def _real(low: float, high: float, seed: int) -> Column:
    return F.rand(seed) * (high - low) + low


def ranges_of(config: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Ranges from a configuration with ``<name>_range_first`` and ``<name>_range_second``."""
    names = [k.removesuffix("_range_first") for k in config if k.endswith("_range_first")]
    return {n: (config[f"{n}_range_first"], config[f"{n}_range_second"]) for n in names}


def ads(spark: SparkSession, n: int, seed: int = SEED, ranges: dict = AD_RANGES, event_time: Column | None = None) -> DataFrame:
    """``ad_id, user_id, cost, event_time``, evenly distributed; made by the executors, the same for a seed and number of partitions."""
    t = F.unix_millis(F.current_timestamp()) if event_time is None else event_time
    return spark.range(n).select(_whole(*ranges["ad_id"], seed).alias("ad_id"), _whole(*ranges["user_id"], seed + 1).alias("user_id"), _real(*ranges["cost"], seed + 2).alias("cost"), t.cast("long").alias("event_time"))


def checkouts(spark: SparkSession, n: int, seed: int = SEED + 10, ranges: dict = CHECKOUT_RANGES, event_time: Column | None = None) -> DataFrame:
    """``purchase_id, user_id, ad_id, value, event_time``."""
    t = F.unix_millis(F.current_timestamp()) if event_time is None else event_time
    return spark.range(n).select(_whole(*ranges["purchase_id"], seed).alias("purchase_id"), _whole(*ranges["user_id"], seed + 1).alias("user_id"), _whole(*ranges["ad_id"], seed + 2).alias("ad_id"), _real(*ranges["value"], seed + 3).alias("value"), t.cast("long").alias("event_time"))


def rate_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """An unending stream of ``timestamp, value`` at a rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def wire(df: DataFrame) -> DataFrame:
    """Rows as comma-separated lines, in column order."""
    return df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]).alias("value"))


@dataclass(frozen=True)
class Pace:
    """Lines in bursts: ``burst`` lines, then ``sleep_ms``. With a ``spike_interval``, bursts are ``spike_magnitude`` times as large for so
    many lines, from the first one, then normal for as many, and so on; a burst ends where the rate changes."""

    burst: int = 2
    sleep_ms: int = 1000
    spike_interval: int = 0
    spike_magnitude: int = 1

    def bursts(self, lines: Iterable[str]) -> Iterator[list[str]]:
        rest, at = list(lines), 0
        while at < len(rest):
            size = self.burst
            if self.spike_interval:
                stretch, used = divmod(at, self.spike_interval)
                size = min(size * (1 if stretch % 2 else self.spike_magnitude), self.spike_interval - used)
            yield rest[at : at + size]
            at += size


def arrival_second(index: Column, pace: Pace = Pace()) -> Column:
    """Burst of a line by its position, from 0: as ``Pace.bursts`` sends it."""
    if not pace.spike_interval:
        return F.floor(index / pace.burst)
    n, large = pace.spike_interval, pace.burst * pace.spike_magnitude
    fast, slow = -(-n // large), -(-n // pace.burst)  # bursts of a stretch
    at = index % (2 * n)
    return F.floor(index / (2 * n)) * (fast + slow) + F.when(at < n, F.floor(at / large)).otherwise(fast + F.floor((at - n) / pace.burst))


def megabytes_rate(rate: float, line_bytes: int, tick_ms: int = 100) -> Pace:
    """The pace of so many MB a second; 0: all at once."""
    return Pace(max(1, int(rate * 1e6 / line_bytes * tick_ms / 1000)), tick_ms) if rate else Pace(1 << 62, 0)


def serve(lines: list[str], port: int = 0, pace: Pace = Pace(1 << 62, 0)) -> tuple[int, threading.Thread]:
    """Serves lines to the first client of a local port, then closes. Returns the port and the serving thread."""
    listener = socket.create_server(("127.0.0.1", port))

    def run() -> None:
        with listener:
            client, _ = listener.accept()
            with client:
                for burst in pace.bursts(lines):
                    client.sendall("".join(f"{x}\n" for x in burst).encode())
                    if pace.sleep_ms:
                        time.sleep(pace.sleep_ms / 1000)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return listener.getsockname()[1], thread


def staged_lines(df: DataFrame) -> list[str]:
    """Rows made first, then stamped with one event time, then written as lines: both streams of a run start together. The server is one
    process, so the lines must fit into it; a cluster's load comes from one generator a rank."""
    made = df.drop("event_time").collect()
    now = int(time.time() * 1000)
    return [",".join([*map(str, row), str(now)]) for row in made]


def serve_ranks(spark: SparkSession, count: int, ranks: int, ports_begin: int = 0, pace: Pace = Pace(1 << 62, 0)) -> list[tuple[int, int]]:
    """Ads and checkouts for each rank, ``count`` rows each, on two ports after each other from ``ports_begin`` (0: any). The ports."""
    out = []
    for r in range(ranks):
        at = ports_begin + 2 * r if ports_begin else 0
        sides = (ads(spark, count, SEED + 100 * r), checkouts(spark, count, SEED + 100 * r + 10))
        ports = [serve(staged_lines(df), at + k if at else 0, pace)[0] for k, df in enumerate(sides)]
        out.append((ports[0], ports[1]))
    return out
