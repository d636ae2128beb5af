"""The profit query on the golden streams: batch, panes, pipelines to sinks, streams from files and ports."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from slidestream.operators.windows import START
from slidestream.plans import dsl
from slidestream.plans.profit import profit_by_window, profit_query
from slidestream.sinks import text
from slidestream.sources import generator, sockets
from slidestream.streaming import replay
from tests import golden

FLUSH_MS = golden.START_MS + 10_000_000
FLUSH = {"ads": "-1,0,0,0", "checkouts": "0,0,-2,0,0"}  # keys that never join


def timed(lines):
    """A batch source of lines with arrival times, two a second."""

    def read(spark):
        rows = [(x, golden.START_MS + k // 2 * 1000) for k, x in enumerate(lines)]
        random.Random(5).shuffle(rows)
        return spark.createDataFrame(rows, "value string, ms long").select("value", F.timestamp_millis("ms").alias("arrival"))

    return read


def windows_of(rows):
    """Rows as in ``golden.ROWS``."""
    return sorted((int(r[START].timestamp() * 1000 - golden.START_MS) // 1000 + 5, r.ad_id, r.profit, r.event_ts, r.row_count) for r in rows)


def rounded(query):
    return query.joined | dsl.rows_output(*query.output)


def test_golden_rows_cover_the_cases():
    assert {a for _, a, *_ in golden.ROWS} == {21, 22, 31, 32, 33}
    assert {w for w, *_ in golden.ROWS} == set(range(1, 12))  # start-up and draining windows
    assert any(p < 0 for _, _, p, _, _ in golden.ROWS) and any(p > 0 for _, _, p, _, _ in golden.ROWS) and (1, 21, 0.0, golden.EARLY, 2) in golden.ROWS
    assert (7, 33, 1.5, golden.EARLY, 2) in golden.ROWS and {t for *_, t, _ in golden.ROWS} == {golden.EARLY, golden.LATE, golden.LAST}


@pytest.mark.parametrize("panes", [False, True])
def test_batch(spark, panes):
    q = profit_query(timed(golden.ADS), timed(golden.CHECKOUTS), panes=panes)
    df = rounded(q).run(spark).withColumn("profit", F.round("profit", 6))
    assert windows_of(df.collect()) == golden.ROWS


def test_one_plan(spark):
    side = lambda lines, ad, amount: timed(lines)(spark).select(F.col("arrival").alias("ts"), F.split("value", ",")[ad].cast("int").alias("ad_id"), F.split("value", ",")[amount].cast("double").alias("amount"))
    rows = profit_by_window(side(golden.ADS, 0, 2), side(golden.CHECKOUTS, 2, 3), 5000, 1000).collect()
    got = sorted((int(r.w_start.timestamp() * 1000 - golden.START_MS) // 1000 + 5, r.ad_id, r.profit, r.n_ads) for r in rows)
    assert got == [(w, a, p, n) for w, a, p, _, n in golden.ROWS]


def test_sinks(spark, tmp_path):
    q = profit_query(timed(golden.ADS), timed(golden.CHECKOUTS))
    (q.joined | dsl.file_output(str(tmp_path / "out"), *q.output)).run(spark)
    lines = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == len(golden.ROWS) and all(len(x.split(",")) == 6 for x in lines)
    assert sorted(x.split(",")[1] for x in lines) == sorted(f"{p:.6f}" for _, _, p, _, _ in golden.ROWS)
    seen = []
    (q.joined | dsl.function_output(3, lambda i, row: seen.append((i, len(row))), *q.output)).run(spark)
    assert seen == [(1, 6), (2, 6), (3, 6)]
    out = io.StringIO()
    from slidestream.operators.project import project

    assert text.to_console(project(q.joined.dataframe(spark), *q.output), out) == len(golden.ROWS) == len(out.getvalue().splitlines())


def streamed(spark, tmp_path, ads, checkouts, name):
    q = profit_query(ads, checkouts, watermark="10 seconds")
    df = rounded(q).run(spark).withColumn("profit", F.round("profit", 6))
    query = text.stream_memory(df, name)
    query.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streaming_files(spark, tmp_path):
    for side, lines in (("ads", golden.ADS), ("checkouts", golden.CHECKOUTS)):
        replay.write_slides(str(tmp_path / side), lines, 2, golden.START_MS, 1000, (FLUSH_MS, FLUSH[side]))
    read = lambda side: lambda s: replay.replayed(s, str(tmp_path / side))
    assert windows_of(streamed(spark, tmp_path, read("ads"), read("checkouts"), "golden_files")) == golden.ROWS


def test_streaming_csv_sink(spark, tmp_path):
    for side, lines in (("ads", golden.ADS), ("checkouts", golden.CHECKOUTS)):
        replay.write_slides(str(tmp_path / side), lines, 2, golden.START_MS, 1000, (FLUSH_MS, FLUSH[side]))
    q = profit_query(*[lambda s, side=side: replay.replayed(s, str(tmp_path / side), 30) for side in ("ads", "checkouts")], watermark="10 seconds")
    (q.joined | dsl.stream_output(str(tmp_path / "out"), str(tmp_path / "check"), *q.output)).run(spark).awaitTermination(120)
    lines = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(x.split(",")[1] for x in lines) == sorted(f"{p:.6f}" for _, _, p, _, _ in golden.ROWS)


def test_ports(spark):
    """Lines from two ports, stamped, over the replaying source."""
    batches = {}
    queries = []
    for name, lines in (("ads", golden.ADS), ("checkouts", golden.CHECKOUTS)):
        port, _ = generator.serve(lines)
        q = sockets.replay_socket_lines(spark, port).writeStream.format("memory").queryName(f"port_{name}").trigger(processingTime="200 milliseconds").start()
        queries.append(q)
        batches[name] = lines
    import time

    until = time.time() + 60
    while time.time() < until and any(spark.table(f"port_{n}").count() < len(x) for n, x in batches.items()):
        time.sleep(0.3)
    for q in queries:
        q.stop()
    for n, x in batches.items():
        assert sorted(r.value for r in spark.table(f"port_{n}").collect()) == sorted(x)


def test_socket_source(spark):
    port, _ = generator.serve(["1,2", "3,4"], pace=generator.Pace(1, 50))
    q = sockets.socket_lines(spark, port).writeStream.format("memory").queryName("plain_port").start()
    import time

    until = time.time() + 60
    while time.time() < until and spark.table("plain_port").count() < 2:
        time.sleep(0.3)
    q.stop()
    rows = spark.table("plain_port").collect()
    assert sorted(r.value for r in rows) == ["1,2", "3,4"] and all(r.arrival for r in rows)


def test_foreach_batch(spark, tmp_path):
    replay.write_slides(str(tmp_path / "in"), ["a", "b", "c"], 2, golden.START_MS, 1000)
    seen = []
    text.stream_function(replay.replayed(spark, str(tmp_path / "in")), lambda df, n: seen.append((n, df.count())), str(tmp_path / "check")).awaitTermination(60)
    assert seen == [(0, 2), (1, 1)]


def test_drain():
    port, _ = generator.serve(["abc"] * 10)
    assert sockets.drain("127.0.0.1", port)["bytes"] == 40


def test_pipeline_errors(spark):
    q = profit_query(timed(golden.ADS), timed(golden.CHECKOUTS))
    from slidestream.fields import Field

    stranger = Field("ad_id", "int")
    with pytest.raises(ValueError, match="isn't among"):
        q.joined | dsl.drop_if(stranger, "== 0")
    with pytest.raises(ValueError, match="source"):
        dsl.append(stranger, "1").__or__(dsl.append(stranger, "1")).dataframe(spark)
    assert os.path.exists(__file__)


def test_ranks(spark):
    ports = generator.serve_ranks(spark, 50, 2)
    assert len(ports) == 2
    assert all(sockets.drain("127.0.0.1", p)["bytes"] > 1000 for pair in ports for p in pair)


def test_vectors(spark):
    df = spark.createDataFrame([([1, 2],), ([3],), ([],), ([4],)], "v array<int>")
    out = io.StringIO()
    assert text.to_console_vectors(df, "v", out) == 2 and out.getvalue() == "1 2\n3\n"
    pairs = spark.createDataFrame([([(1, 2), (3, 4)],)], "v array<struct<a:int,b:int>>")
    out = io.StringIO()
    text.to_console_vectors(pairs, "v", out, first_only=True)
    assert out.getvalue() == "1 3\n"


def test_console_pipeline(spark, capsys):
    q = profit_query(timed(golden.ADS), timed(golden.CHECKOUTS), panes=True)
    assert (q.joined | dsl.console_output(*q.output)).run(spark) == len(golden.ROWS)
    assert len(capsys.readouterr().out.splitlines()) == len(golden.ROWS)


def test_rate_and_console_streams(spark, tmp_path):
    q = text.stream_console(generator.rate_stream(spark, 5), processingTime="500 milliseconds")
    import time

    time.sleep(3)
    assert q.exception() is None and q.lastProgress is not None
    q.stop()


def test_lines_of_files(spark, tmp_path):
    from slidestream.sources import batch

    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    assert [r.value for r in batch.csv_lines(spark, str(tmp_path / "a.csv")).collect()] == ["1,2", "3,4"]


def test_processing_time_windows(spark):
    """Without arrival times of their own, rows are in the windows of the moment their batch runs."""
    from slidestream.fields import AggSchema, Field
    from slidestream.operators import windows

    key, one = Field("k", "int"), Field("n", "long")
    df = spark.range(10).select((F.col("id") % 2).cast("int").alias(key.column), F.lit(1).alias(one.column), F.current_timestamp().alias("now"))
    out = windows.sliding_aggregate(df, "now", 5000, 1000, AggSchema.of((key, "key"), (one, "sum"))).collect()
    assert len(out) == 10 and all(r[one.column] == 5 for r in out)


def test_stream_state_is_bounded(spark, tmp_path):
    """Twelve days of events, a file a batch: panes behind the watermark leave the state, and windows are those of the batch."""
    from datetime import datetime, timedelta

    from slidestream.plans.profit import profit_of_sides
    from slidestream.streaming import profit as stream_profit

    hour, rng = 3_600_000, random.Random(2)
    schema = "ts timestamp_ntz, ad_id int, cost double, value double"
    for day in range(12):
        rows = [(datetime(2024, 1, 1) + timedelta(days=day, minutes=rng.randrange(1440)), rng.randrange(1, 6), *rng.choice([(1.25, None), (None, 2.5)])) for _ in range(200)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/d={day}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = stream_profit.start(stream, hour, str(tmp_path / "out"), "1 hour")
    query.awaitTermination(300)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(state) == 12 and max(state) < 3 * 24 * 5
    got = stream_profit.latest(spark, str(tmp_path / "out"), 5 * hour, hour)
    want = profit_of_sides(spark.read.schema(schema).parquet(str(tmp_path / "in/*")), 5 * hour, hour)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
