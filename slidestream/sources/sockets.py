"""Streams from TCP ports: Spark's socket source, and a source that can replay what it has handed out.

``replay_socket`` keeps lines of a port in the reader until their batch is committed, so a batch that is repeated within the life of the
driver gets the same lines. Neither survives a lost driver: a TCP peer can't be asked for old lines.
"""

from __future__ import annotations

import socket
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from slidestream.operators.exchange import union_ranks
from slidestream.shared import ship

#: Two ports for each rank, ads first. Fixed values.
AD_PORT, CHECKOUT_PORT, PORTS_PER_RANK = 12345, 12346, 2


def socket_lines(spark: SparkSession, port: int, host: str = "127.0.0.1") -> DataFrame:
    """Lines as ``value``, their time of arrival as ``arrival``."""
    df = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return df.withColumnRenamed("timestamp", "arrival")


def rank_lines(spark: SparkSession, port: int, ranks: int, host: str = "127.0.0.1") -> DataFrame:
    """The union of the same stream's ports of all ranks."""
    return union_ranks([socket_lines(spark, port + PORTS_PER_RANK * r, host) for r in range(ranks)])


class _Lines(SimpleDataSourceStreamReader):
    """Spark copies the reader before use, so it connects on the first read."""

    def __init__(self, host: str, port: int):
        self.address = (host, port)
        self.lines: list[str] = []
        self.first = 0  # lines before this one are committed and gone
        self.lock = None

    def _connect(self) -> None:
        if self.lock is None:
            self.lock = threading.Lock()
            threading.Thread(target=self._receive, daemon=True).start()

    def _receive(self) -> None:
        rest = b""
        with socket.create_connection(self.address) as s:
            while data := s.recv(1 << 21):
                *whole, rest = (rest + data).split(b"\n")
                with self.lock:
                    self.lines += [x.decode("utf-8", "replace") for x in whole]
        if rest:
            with self.lock:
                self.lines.append(rest.decode("utf-8", "replace"))

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._connect()
        with self.lock:
            out = self.lines[start["line"] - self.first :]
        return iter([(x,) for x in out]), {"line": start["line"] + len(out)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        self._connect()
        with self.lock:
            out = self.lines[start["line"] - self.first : end["line"] - self.first]
        return iter([(x,) for x in out])

    def commit(self, end: dict) -> None:
        self._connect()
        with self.lock:
            del self.lines[: end["line"] - self.first]
            self.first = end["line"]


class ReplaySocket(DataSource):
    """``spark.readStream.format("replay_socket").option("port", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "replay_socket"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Lines(self.options.get("host", "127.0.0.1"), int(self.options["port"]))


def replay_socket_lines(spark: SparkSession, port: int, host: str = "127.0.0.1") -> DataFrame:
    ship(spark)
    spark.dataSource.register(ReplaySocket)
    return spark.readStream.format("replay_socket").option("host", host).option("port", port).load()


def port_text(host: str, port: int) -> str:
    """All that a port sends until it closes."""
    with socket.create_connection((host, port)) as s, s.makefile("r", encoding="utf-8", newline="") as f:
        return f.read()


def drain(host: str, port: int) -> dict[str, float]:
    """Reads a port to its end: seconds, bytes, megabytes a second."""
    import time

    n, began = 0, time.time()
    with socket.create_connection((host, port)) as s:
        while data := s.recv(1 << 21):
            n += len(data)
    seconds = time.time() - began
    return {"seconds": seconds, "bytes": float(n), "mb_per_s": n / 1e6 / seconds if seconds else 0.0}


__all__ = ["AD_PORT", "CHECKOUT_PORT", "ReplaySocket", "drain", "port_text", "rank_lines", "replay_socket_lines", "socket_lines"]
