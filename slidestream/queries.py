"""The engine's operators as queries over the shared tables, each with DuckDB SQL.

Of ``events``, views and clicks are ads, purchases are checkouts; the ad is the number in ``props``, amounts are ``value``. Data span days,
so windows of five hours stand for those of five seconds. Amounts are added as decimals, so sums don't depend on the order of rows.
"""

from __future__ import annotations

import io
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidestream import analytics
from slidestream.fields import AggSchema, Field, Schema
from slidestream.functions.scalar import diff, greater, money, split_tokens
from slidestream.operators import aggregate, exchange, filters, joins, parse, project, windows
from slidestream.plans import dsl
from slidestream.plans.profit import profit_by_window, profit_of_sides, profit_query
from slidestream.shared import new_folder
from slidestream.sinks import text
from slidestream.sources import batch, generator, sockets
from slidestream.streaming import profit as stream_profit

HOUR = 3_600_000
SIZE, SLIDE = 5 * HOUR, HOUR
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_k(props: Column) -> Column:
    """The number ``k`` of a JSON object. Objects with nothing else, the rule here, are cut out of the text, others are parsed."""
    bare = F.when(props.startswith('{"k": ') & props.endswith("}"), F.substring(props, F.lit(7), F.length(props) - 7).try_cast("int"))
    return F.coalesce(bare, F.get_json_object(props, "$.k").try_cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ad_id", number_k(F.col("props")))


def sides(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Ads and checkouts in one scan, as ``profit_of_sides`` takes them."""
    rows = events(spark, sf_dir)
    if stream:
        found = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
        rows = found.withColumn("ad_id", number_k(F.col("props")))
    cost = F.when(F.col("event_type").isin("view", "click"), F.col("value"))
    value = F.when((F.col("event_type") == "purchase") & (F.col("ad_id") != 0), F.col("value"))
    return rows.where("event_type IN ('view', 'click', 'purchase')").select("ts", "user_id", "ad_id", cost.alias("cost"), value.alias("value"))


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type IN ('view', 'click')").select("event_id", "ts", "user_id", "ad_id", F.col("value").alias("amount"))


def checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "ts", "user_id", "ad_id", F.col("value").alias("amount"))


def total(c: str | Column) -> Column:
    return F.sum(money(F.col(c) if isinstance(c, str) else c)).cast("double")


def millis(c: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, whatever the session's zone."""
    since = (c - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).cast("interval second").cast("decimal(18,6)")
    return F.floor(since * 1000).cast("long")


_E = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS ad_id FROM events)"
_ADS = "ads AS (SELECT event_id, ts, user_id, ad_id, value AS amount FROM e WHERE event_type IN ('view', 'click'))"
_CHECKOUTS = "checkouts AS (SELECT event_id, ts, user_id, ad_id, value AS amount FROM e WHERE event_type = 'purchase')"
_SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
_COPIES = "(SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS w_start FROM {}, unnest([0, 1, 2, 3, 4]) AS _(k))"
_PROFIT = f"""{_E}, {_ADS}, {_CHECKOUTS},
a AS (SELECT w_start, ad_id, sum(CAST(amount AS DECIMAL(18,2))) AS cost, max(ts) AS ts, count(*) AS n FROM {_COPIES.format('ads')} GROUP BY ALL),
c AS (SELECT w_start, ad_id, sum(CAST(amount AS DECIMAL(18,2))) AS value, max(ts) AS ts FROM {_COPIES.format('checkouts')} WHERE ad_id <> 0 GROUP BY ALL),
profit AS (SELECT a.w_start, a.ad_id, CAST(c.value - a.cost AS DOUBLE) AS profit, greatest(a.ts, c.ts) AS max_ts, a.n AS n_ads
           FROM a JOIN c ON a.w_start = c.w_start AND a.ad_id = c.ad_id)"""
_RESULTS = _PROFIT + """,
r AS (SELECT w_start, ad_id, (epoch_us(max_ts) // 1000) AS event_ts, (epoch_us(max_ts) // 1000) + 50 + ad_id AS process_ts, (epoch_us(w_start) // 1000) + 18000000 AS final_ts, n_ads AS row_count FROM profit),
x AS (SELECT *, final_ts - (SELECT min(event_ts) FROM r) AS elapsed FROM r)"""


# ---------------------------------------------------------------- flagship


@query(f"WITH {_PROFIT} SELECT w_start, ad_id, profit, max_ts, CAST(n_ads AS BIGINT) AS n_ads FROM profit")
def window_join_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' panes in one aggregation; the join is a filter on its groups."""
    return profit_of_sides(sides(spark, sf_dir), SIZE, SLIDE)


@query(f"WITH {_PROFIT} SELECT w_start, ad_id, profit, max_ts, CAST(n_ads AS BIGINT) AS n_ads FROM profit")
def stream_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as a stream over the events' files, run to their end."""
    return stream_profit.run(sides(spark, sf_dir, stream=True), SIZE, SLIDE)


def _side(df: DataFrame, name: str) -> tuple[DataFrame, Field, Field, Field]:
    """Pane sums of one side, and the fields of its columns."""
    key, amount, ts = Field("ad_id", "int"), Field(name, "double"), Field("ts", "timestamp")
    rows = df.select("ts", F.col("ad_id").alias(key.column), F.col("amount").alias(amount.column), F.col("ts").alias(ts.column))
    spec = AggSchema.of((key, "key"), (amount, "sum"), (ts, "max"))
    exact = rows.withColumn(amount.column, money(F.col(amount.column)))
    return windows.pane_aggregate(exact, "ts", SIZE, SLIDE, spec), key, amount, ts


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's rows with stand-ins for wall-clock times: processed 50 ms and the ad's number after the event, final at the window's end."""
    p = profit_of_sides(sides(spark, sf_dir), SIZE, SLIDE)
    return p.select("w_start", "ad_id", millis(F.col("max_ts")).alias("event_ts"), (millis(F.col("max_ts")) + 50 + F.col("ad_id")).alias("process_ts"), (millis(F.col("w_start")) + SIZE).alias("final_ts"), F.col("n_ads").alias("row_count"))


# ---------------------------------------------------------------- rows


@query("SELECT event_id, value FROM events WHERE value >= 50 AND event_type <> 'error'")
def filter_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep_if(table(spark, sf_dir, "events"), "value >= 50 && !(event_type == 'error')").select("event_id", "value")


@query(f"WITH {_E}, {_CHECKOUTS} SELECT event_id, ad_id FROM checkouts WHERE ad_id <> 0")
def filter_dropif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_if(checkouts(spark, sf_dir), "ad_id", "== 0").select("event_id", "ad_id")


@query(f"WITH {_E}, {_ADS} SELECT event_id, CAST(1 AS BIGINT) AS num_tuple, CAST(user_id % 10 AS INTEGER) AS bucket FROM ads")
def append_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, bucket = Field("num_tuple", "uint64"), Field("bucket", "int")
    df = project.append(project.append(ads(spark, sf_dir), one, "1"), bucket, "user_id % 10")
    return df.select("event_id", F.col(one.column).alias("num_tuple"), F.col(bucket.column).alias("bucket"))


@query(None)
def append_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall clock, so rows only: ``processed`` is the same for all rows of a batch."""
    t = Field("processed", "uint64")
    return project.append_timestamp(ads(spark, sf_dir), t).select("event_id", F.col(t.column).alias("processed"))


@query(f"WITH {_E}, {_ADS} SELECT count(*) AS n, true AS one_time, true AS whole_ms, true AS now FROM ads")
def append_timestamp_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The appended time is whole milliseconds, one value for a batch, between the query's start and its end."""
    seen, began = Field("seen", "uint64"), int(time.time() * 1000)
    rows = project.append_timestamp(ads(spark, sf_dir), seen)
    found = rows.agg(F.count("*").alias("n"), F.min(seen.column).alias("lo"), F.max(seen.column).alias("hi")).first()
    return spark.createDataFrame([(found.n, found.lo == found.hi, isinstance(found.lo, int), began <= found.lo <= int(time.time() * 1000))], "n long, one_time boolean, whole_ms boolean, now boolean")



def _line_fields(spark: SparkSession, sf_dir: str, strategy) -> DataFrame:
    price, discount, out = Field("price", "double"), Field("discount", "double"), Field("out", "double")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias(price.column), F.col("l_quantity").alias(discount.column))
    return project.combine(df, out, price, discount, strategy).select("l_orderkey", "l_linenumber", F.round(out.column, 6).alias("out"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 6) AS out FROM lineitem")
def combine_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_fields(spark, sf_dir, diff)


@query("SELECT l_orderkey, l_linenumber, round(greatest(l_extendedprice, l_quantity), 6) AS out FROM lineitem")
def combine_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_fields(spark, sf_dir, greater)


@query("SELECT event_id, CAST(value * 2 AS DOUBLE) AS doubled, upper(event_type) AS kind FROM events")
def map_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.map_columns(table(spark, sf_dir, "events"), event_id=F.col("event_id"), doubled=F.col("value") * 2, kind=F.upper("event_type"))


@query("SELECT event_id, value + 1 AS raised FROM events")
def map_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.map_rows(table(spark, sf_dir, "events").select("event_id", "value"), lambda p: p.assign(raised=p["value"] + 1)[["event_id", "raised"]], "event_id long, raised double")


@query("SELECT event_id || ',' || event_type || ',' || printf('%.6f', value) AS value FROM events")
def project_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a file or console sink has them: fractions with six decimals."""
    return text.lines(table(spark, sf_dir, "events").select("event_id", "event_type", "value"))


@query(f"WITH {_E} SELECT ad_id, user_id, value AS cost, (epoch_us(ts) // 1000) AS event_time FROM e WHERE event_type IN ('view', 'click')")
def parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to wire lines and parsed again."""
    fields = Schema.of(Field("ad_id", "int"), Field("user_id", "long"), Field("cost", "double"), Field("event_time", "uint64"))
    lines = generator.wire(ads(spark, sf_dir).select("ad_id", "user_id", "amount", millis(F.col("ts")).alias("t")))
    return project.project(parse.accepted(parse.parse_csv(lines, fields)), *fields)


@query("SELECT event_type || ',' || event_id AS line FROM events")
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that aren't two numbers, kept as they are."""
    lines = table(spark, sf_dir, "events").select(F.concat_ws(",", "event_type", "event_id").alias("value"))
    return parse.rejected(parse.parse_csv(lines, Schema.of(Field("a", "int"), Field("b", "long")))).select(F.col(parse.REJECT).alias("line"))


@query(f"WITH {_E} SELECT event_id, ad_id FROM e")
def json_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "ad_id")


@query("SELECT event_type AS key, CAST(floor(value) AS INTEGER) AS value, (epoch_us(ts) // 1000) AS ts FROM events")
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lines = e.select(F.to_json(F.struct(F.col("event_type").alias("key"), F.floor("value").cast("string").alias("value"), millis(F.col("ts")).cast("string").alias("ts"))).alias("value"))
    return batch.json_events(lines)


@query("SELECT w AS token, count(*) AS n FROM (SELECT unnest(string_split_regex(o_orderpriority || '  ' || o_orderstatus, '[ ]+')) AS w FROM orders) WHERE w <> '' GROUP BY ALL")
def token_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("  ", "o_orderpriority", "o_orderstatus").alias("value"))
    return lines.select(F.explode(split_tokens(F.col("value"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1), (2), (3)) AS t(value) WHERE value < 10")
def constant_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep_if(batch.constants(spark, [1, 2, 3]), "value < 10")


@query("SELECT CAST(100000 AS BIGINT) AS n, true AS in_range, true AS all_ads")
def generated_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = generator.ads(spark, 100_000)
    low, high = generator.AD_RANGES["cost"]
    return a.agg(F.count("*").alias("n"), F.bool_and(F.col("ad_id").between(1, 1000) & F.col("user_id").between(0, 100) & (F.col("cost") >= low) & (F.col("cost") < high)).alias("in_range"), (F.count_distinct("ad_id") == 1000).alias("all_ads"))


@query("SELECT CAST(100000 AS BIGINT) AS n, true AS in_range, true AS has_zero")
def generated_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = generator.checkouts(spark, 100_000)
    ok = F.col("purchase_id").between(0, 10000) & F.col("ad_id").between(0, 1000) & F.col("user_id").between(0, 100) & (F.col("value") >= 10) & (F.col("value") < 100)
    return c.agg(F.count("*").alias("n"), F.bool_and(ok).alias("in_range"), (F.min("ad_id") == 0).alias("has_zero"))


_POSITIONS = f"{_E}, i AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM e WHERE event_type = 'purchase')"


@query(f"WITH {_POSITIONS} SELECT event_id, CAST(i // 2 AS BIGINT) AS second FROM i")
def replay_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival seconds of a replay at two lines a second."""
    lines = exchange.with_positions(checkouts(spark, sf_dir).select("event_id"), "event_id")
    return lines.select("event_id", generator.arrival_second(F.col("position")).alias("second"))


@query(f"WITH {_POSITIONS} SELECT event_id, CAST(i // 200 * 41 + CASE WHEN i % 200 < 100 THEN i % 200 // 15 ELSE 7 + (i % 200 - 100) // 3 END AS BIGINT) AS second FROM i")
def replay_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At three lines a second, five times as many in every other hundred lines."""
    lines = exchange.with_positions(checkouts(spark, sf_dir).select("event_id"), "event_id")
    return lines.select("event_id", generator.arrival_second(F.col("position"), generator.Pace(3, 1000, 100, 5)).alias("second"))


# ---------------------------------------------------------------- ports, files, console


def _nation_lines(spark: SparkSession, sf_dir: str) -> list[str]:
    """A table of 25 rows as lines, in order of the key."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name").orderBy("n_nationkey")
    return [f"{r.n_nationkey},{r.n_regionkey},{r.n_name}" for r in rows.collect()]


@query("SELECT CAST(n_nationkey AS INTEGER) AS key, CAST(n_regionkey AS INTEGER) AS region, n_name AS name FROM nation")
def port_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of two ranks' ports as one stream, written to files and parsed."""
    lines, folder = _nation_lines(spark, sf_dir), new_folder(spark, "ports")
    ports = [generator.serve(lines[r::2], pace=generator.Pace(5, 20))[0] for r in range(2)]
    whole = exchange.union_ranks([sockets.socket_lines(spark, p) for p in ports]).select("value")
    stream = text.stream_csv(whole, f"{folder}/rows", f"{folder}/checkpoint", processingTime="100 milliseconds")
    until = time.time() + 120
    while stream.isActive and time.time() < until and sum(p["numInputRows"] for p in stream.recentProgress) < len(lines):
        time.sleep(0.1)
    stream.processAllAvailable()
    stream.stop()
    fields = [Field("key", "int"), Field("region", "int"), Field("name", "string")]
    return project.project(parse.accepted(parse.parse_csv(batch.csv_lines(spark, f"{folder}/rows"), Schema.of(*fields))), *fields)


@query("SELECT sum(strlen(n_nationkey || ',' || n_regionkey || ',' || n_name) + 1)::BIGINT AS bytes, true AS timed FROM nation")
def port_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sockets.drain("127.0.0.1", generator.serve(_nation_lines(spark, sf_dir))[0])
    return spark.createDataFrame([(int(found["bytes"]), found["seconds"] > 0 and found["mb_per_s"] > 0)], "bytes long, timed boolean")


@query("SELECT CAST(n_nationkey AS INTEGER) AS value FROM nation UNION ALL SELECT TRY_CAST(unnest(string_split(n_name, ' ')) AS INTEGER) FROM nation")
def typed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text; what is no number is null."""
    return batch.tokens(spark, io.StringIO("\n".join(x.replace(",", " ").split(" ", 1)[0] + "\t" + x.split(",")[2] for x in _nation_lines(spark, sf_dir))), "int")


@query("SELECT 'price' AS name, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem UNION ALL SELECT 'quantity', min(l_quantity), max(l_quantity) FROM lineitem")
def config_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges written as a header and a line, and read as a generator's configuration."""
    path = new_folder(spark, "config")
    bounds = [f(c).alias(f"{n}_range_{end}") for n, c in (("price", "l_extendedprice"), ("quantity", "l_quantity")) for end, f in (("first", F.min), ("second", F.max))]
    table(spark, sf_dir, "lineitem").agg(*bounds).write.option("header", True).csv(path)
    found = generator.ranges_of(batch.config(spark, path))
    return spark.createDataFrame([(n, *r) for n, r in found.items()], "name string, low double, high double")


@query("SELECT * FROM (VALUES (0, 'ads', 300, true, true, true), (0, 'checkouts', 300, true, true, true), (1, 'ads', 300, true, true, true), (1, 'checkouts', 300, true, true, true)) AS t(rank, side, n, in_range, one_time, paced)")
def ranked_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranks' generated streams, drained from their ports: rows made first, stamped with one time, sent at a rate."""
    pace, out = generator.megabytes_rate(0.05, 30), []
    for rank, ports in enumerate(generator.serve_ranks(spark, 300, 2, pace=pace)):
        for side, port in zip(("ads", "checkouts"), ports):
            began = time.time()
            rows = [x.split(",") for x in sockets.port_text("127.0.0.1", port).splitlines()]
            ad, amount = (0, 2) if side == "ads" else (2, 3)
            fits = all((side == "checkouts") <= (0 <= int(r[ad]) <= 1000) and int(r[ad]) >= (side == "ads") and 10 <= float(r[amount]) < 100 for r in rows)
            out.append((rank, side, len(rows), fits, len({r[-1] for r in rows}) == 1, time.time() - began >= (300 // pace.burst - 1) * pace.sleep_ms / 1000))
    return spark.createDataFrame(out, "rank int, side string, n int, in_range boolean, one_time boolean, paced boolean")


@query("SELECT p_partkey || ',' || coalesce(p_name, '') || ',' || printf('%.6f', p_retailprice) AS line FROM part")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines with six decimals, in files without header that replace what was there, read again."""
    path = new_folder(spark, "csv")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    text.write_csv(rows.limit(1), path)
    text.write_csv(rows, path)
    return batch.csv_lines(spark, path).select(F.col("value").alias("line"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region, in order, and an empty list after them."""
    nations = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations")
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(nations)
    end = spark.range(2).select((F.col("id") + 100).alias("n_regionkey"), F.lit(None).cast(lists.schema["nations"].dataType).alias("nations"))
    return lists.union(end.select(F.col("n_regionkey").cast(lists.schema["n_regionkey"].dataType), F.coalesce("nations", F.array().cast(lists.schema["nations"].dataType)))).coalesce(1).sortWithinPartitions("n_regionkey")


def _printed(spark: SparkSession, out: io.StringIO) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(out.getvalue().splitlines())], "i long, line string")


@query("SELECT row_number() OVER (ORDER BY n_regionkey) - 1 AS i, string_agg(n_nationkey || ',' || n_name, ' ' ORDER BY n_nationkey) AS line FROM nation GROUP BY n_regionkey")
def vector_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as printed, up to the first empty one."""
    out = io.StringIO()
    text.to_console_vectors(_regions(spark, sf_dir), "nations", out)
    return _printed(spark, out)


@query("SELECT row_number() OVER (ORDER BY n_regionkey) - 1 AS i, string_agg(n_nationkey::VARCHAR, ' ' ORDER BY n_nationkey) AS line FROM nation GROUP BY n_regionkey")
def vector_sink_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each element the first field only."""
    out = io.StringIO()
    text.to_console_vectors(_regions(spark, sf_dir), "nations", out, first_only=True)
    return _printed(spark, out)


@query("SELECT row_number() OVER (ORDER BY n_name) AS i, n_name AS name FROM nation ORDER BY n_name LIMIT 7")
def function_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a function was called with: the first seven rows and their numbers."""
    seen: list[tuple[int, str]] = []
    text.to_function(table(spark, sf_dir, "nation").select("n_name").orderBy("n_name"), 7, lambda i, row: seen.append((i, row.n_name)))
    return spark.createDataFrame(seen, "i long, name string")


# ---------------------------------------------------------------- aggregates and windows


@query(f"WITH {_E}, {_ADS} SELECT ad_id, {_SUM.format('amount')} AS out FROM ads GROUP BY ALL")
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents are added, as whole numbers."""
    key, cents = Field("ad_id", "int"), Field("out", "long")
    df = ads(spark, sf_dir).select(F.col("ad_id").alias(key.column), (money(F.col("amount")) * 100).cast("long").alias(cents.column))
    out = project.project(aggregate.aggregate(df, AggSchema.of((key, "key"), (cents, "sum"))), key, cents)
    return out.withColumn("out", (F.col("out").cast("decimal(18,0)") / 100).cast("double"))


@query(f"WITH {_E}, {_ADS} SELECT ad_id, min(amount) AS out FROM ads GROUP BY ALL")
def agg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, amount = Field("ad_id", "int"), Field("out", "double")
    df = ads(spark, sf_dir).select(F.col("ad_id").alias(key.column), F.col("amount").alias(amount.column))
    return project.project(aggregate.aggregate(df, AggSchema.of((key, "key"), (amount, "min"))), key, amount)


@query(f"WITH {_E}, {_ADS} SELECT ad_id, max(amount) AS out FROM ads GROUP BY ALL")
def agg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, amount = Field("ad_id", "int"), Field("out", "double")
    df = ads(spark, sf_dir).select(F.col("ad_id").alias(key.column), F.col("amount").alias(amount.column))
    return project.project(aggregate.aggregate(df, AggSchema.of((key, "key"), (amount, "max"))), key, amount)


@query(f"WITH {_E}, {_ADS} SELECT ad_id, count(*) AS out FROM ads GROUP BY ALL")
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the sum of an appended 1."""
    key, one = Field("ad_id", "int"), Field("out", "uint64")
    df = project.append(ads(spark, sf_dir).select(F.col("ad_id").alias(key.column)), one, "1")
    return project.project(aggregate.aggregate(df, AggSchema.of((key, "key"), (one, "sum"))), key, one)


@query(f"WITH {_E}, {_ADS} SELECT ad_id, arg_min(user_id, event_id) AS user_id FROM ads GROUP BY ALL")
def agg_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that arrived first."""
    key, user = Field("ad_id", "int"), Field("user_id", "long")
    df = ads(spark, sf_dir).select("event_id", F.col("ad_id").alias(key.column), F.col("user_id").alias(user.column))
    return project.project(aggregate.aggregate(df, AggSchema.of((key, "key"), (user, "noop")), arrival="event_id"), key, user)


@query("SELECT l_returnflag AS flag, l_linestatus AS status, min(l_quantity) AS low, max(l_extendedprice) AS high, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY ALL")
def agg_schema_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status, low, high, n, last = Field("flag", "string"), Field("status", "string"), Field("low", "double"), Field("high", "double"), Field("n", "uint64"), Field("last", "local_timestamp")
    source = {flag: F.col("l_returnflag"), status: F.col("l_linestatus"), low: F.col("l_quantity"), high: F.col("l_extendedprice"), n: F.lit(1)}
    df = table(spark, sf_dir, "lineitem").select(*[c.alias(f.column) for f, c in source.items()], F.col("l_shipdate").alias(last.column))
    out = aggregate.aggregate(df, AggSchema.of((flag, "key"), (status, "key"), (low, "min"), (high, "max"), (n, "sum"), (last, "max")))
    return project.project(out, flag, status, low, high, n, last)


@query(f"WITH {_E}, {_ADS} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS w_end, ad_id, {_SUM.format('amount')} AS cost, count(*) AS n FROM ads GROUP BY ALL")
def tumbling_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(ads(spark, sf_dir), "ts", HOUR).groupBy("w_start", "w_end", "ad_id").agg(total("amount").alias("cost"), F.count("*").alias("n"))


_SLIDING = f"WITH {_E}, {_ADS} SELECT w_start, w_start + INTERVAL 5 HOUR AS w_end, ad_id, {_SUM.format('amount')} AS cost, max(amount) AS high, arg_min(user_id, event_id) AS user_id, count(*) AS n FROM {_COPIES.format('ads')} GROUP BY ALL"


def _sliding(spark: SparkSession, sf_dir: str, run) -> DataFrame:
    key, cost, high, user, n = Field("ad_id", "int"), Field("cost", "double"), Field("high", "double"), Field("user_id", "long"), Field("n", "uint64")
    df = ads(spark, sf_dir).select("ts", "event_id", F.col("ad_id").alias(key.column), F.col("amount").alias(high.column), money(F.col("amount")).alias("_money"), F.col("user_id").alias(user.column), F.lit(1).alias(n.column))
    df = df.withColumn(cost.column, F.col("_money")).drop("_money")
    out = run(df, "ts", SIZE, SLIDE, AggSchema.of((key, "key"), (cost, "sum"), (high, "max"), (user, "noop"), (n, "sum")), "event_id")
    return out.select("w_start", "w_end", *[F.col(f.column).alias(f.name) for f in (key, cost, high, user, n)])


@query(_SLIDING.replace(_SUM.format("amount"), "round(" + _SUM.format("amount") + ", 2)"))
def sliding_agg_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliding(spark, sf_dir, windows.sliding_aggregate).withColumn("cost", F.round("cost", 2))


@query(_SLIDING.replace(_SUM.format("amount"), "round(" + _SUM.format("amount") + ", 2)"))
def sliding_agg_pane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliding(spark, sf_dir, windows.pane_aggregate).withColumn("cost", F.round("cost", 2))


@query(f"WITH {_E}, {_ADS}, w AS (SELECT w_start, count(*) AS n FROM {_COPIES.format('ads')} GROUP BY ALL) SELECT w_start, n FROM w WHERE w_start < (SELECT min(time_bucket(INTERVAL 1 HOUR, ts)) FROM ads) OR w_start > (SELECT max(time_bucket(INTERVAL 1 HOUR, ts)) - INTERVAL 4 HOUR FROM ads)")
def partial_startup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that hold fewer than five slides of data: those before the first full one and those that drain."""
    a = ads(spark, sf_dir)
    panes = a.groupBy(F.window("ts", "1 hour").start.alias("pane")).agg(F.count("*").alias("n"))
    ends = panes.agg(F.min("pane").alias("lo"), (F.max("pane") - F.expr("INTERVAL 4 HOURS")).alias("hi"))
    w = panes.withColumn("w_start", windows.windows_of_pane(F.col("pane"), SIZE, SLIDE)).groupBy("w_start").agg(F.sum("n").alias("n"))
    return w.join(F.broadcast(ends)).where("w_start < lo OR w_start > hi").select("w_start", "n")  # one row


# ---------------------------------------------------------------- joins and distribution


@query(f"WITH {_PROFIT} SELECT a.w_start, a.ad_id, CAST(a.cost AS DOUBLE) AS cost, CAST(c.value AS DOUBLE) AS value FROM a JOIN c ON a.w_start = c.w_start AND a.ad_id = c.ad_id")
def hash_join_1to1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pane aggregates joined by window and key, as any two windowed streams are."""
    left, lk, cost, _ = _side(ads(spark, sf_dir), "cost")
    right, rk, value, _ = _side(filters.drop_if(checkouts(spark, sf_dir), "ad_id", "== 0"), "value")
    return joins.window_join(left, right, lk, rk).select("w_start", F.col(lk.column).alias("ad_id"), F.round(cost.column, 2).alias("cost"), F.round(value.column, 2).alias("value"))


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def hash_join_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.multi_join(orders, lines, "o_orderkey", "l_orderkey").drop("l_orderkey")


@query("SELECT p.l_partkey, s.l_suppkey, count(*) AS n FROM lineitem p JOIN lineitem s ON p.l_partkey = s.l_partkey GROUP BY ALL")
def hash_join_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of two lines of a part; pairs are joined first and counted then."""
    lines = table(spark, sf_dir, "lineitem")
    p, s = lines.select("l_partkey"), lines.select(F.col("l_partkey").alias("part"), "l_suppkey")
    return joins.multi_join(p, s, "l_partkey", "part").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query(f"""WITH {_E}, {_ADS}, {_CHECKOUTS},
a AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, ad_id, sum(CAST(amount AS DECIMAL(18,2))) AS cost, max(ts) AS ts, max(event_id) AS seen FROM ads GROUP BY ALL),
c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, ad_id, sum(CAST(amount AS DECIMAL(18,2))) AS value, max(ts) AS ts, max(event_id) AS seen FROM checkouts WHERE ad_id <> 0 GROUP BY ALL)
SELECT a.w_start, a.ad_id, CAST(value - cost AS DOUBLE) AS profit, greatest(a.ts, c.ts) AS max_ts, CASE WHEN a.ts > c.ts THEN a.seen ELSE c.seen END AS seen FROM a JOIN c ON a.w_start = c.w_start AND a.ad_id = c.ad_id""")
def window_join_tumbling_tie_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows; ``seen`` is taken from the side with the later event."""
    side = lambda df, amount, ts, seen: windows.tumbling(df, "ts", HOUR).groupBy("w_start", "ad_id").agg(F.sum(money(F.col("amount"))).alias(amount), F.max("ts").alias(ts), F.max("event_id").alias(seen))
    both = side(ads(spark, sf_dir), "cost", "t1", "s1").join(side(checkouts(spark, sf_dir).where("ad_id <> 0"), "value", "t2", "s2"), ["w_start", "ad_id"])
    return both.select("w_start", "ad_id", (F.col("value") - F.col("cost")).cast("double").alias("profit"), F.greatest("t1", "t2").alias("max_ts"), joins.of_latest(F.col("t1"), F.col("t2"), F.col("s1"), F.col("s2")).alias("seen"))


@query(f"WITH {_E}, {_ADS} SELECT ad_id, {_SUM.format('amount')} AS cost, count(*) AS n FROM ads GROUP BY ALL")
def multi_rank_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of four ranks as one."""
    a = ads(spark, sf_dir)
    whole = exchange.union_ranks([exchange.in_rank(a, "user_id", r, 4) for r in range(4)])
    return whole.groupBy("ad_id").agg(total("amount").alias("cost"), F.count("*").alias("n"))


@query(f"WITH {_E}, {_ADS} SELECT ad_id, {_SUM.format('amount')} AS cost FROM ads GROUP BY ALL")
def hash_repartition_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums before the exchange, final ones after it."""
    partial = ads(spark, sf_dir).groupBy("ad_id", F.spark_partition_id().alias("p")).agg(F.sum(money(F.col("amount"))).alias("cost"))
    return exchange.hash_partition(partial, 8, "ad_id").groupBy("ad_id").agg(F.sum("cost").cast("double").alias("cost"))


# ---------------------------------------------------------------- analytics


@query(f"WITH {_RESULTS} SELECT elapsed, min(final_ts - event_ts) AS event_latency, min(final_ts - process_ts) AS processing_latency FROM x GROUP BY ALL")
def latency_min_by_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.min_latency(analytics.with_elapsed(results(spark, sf_dir)), "elapsed")


@query(f"WITH {_RESULTS} SELECT elapsed - elapsed % 86400000 AS bucket, CAST(sum(row_count) * 2 / 5 AS DOUBLE) AS throughput FROM x GROUP BY ALL")
def throughput_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.throughput_buckets(analytics.with_elapsed(results(spark, sf_dir)), 24 * HOUR)


@query(f"WITH {_RESULTS} SELECT (max(final_ts) - min(event_ts)) / 1000 AS seconds FROM r")
def runtime_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.runtime(results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT sum(row_count) * 2 / 5 * 1000 / (max(final_ts) - min(event_ts)) AS throughput FROM r")
def avg_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.average_throughput(results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT ad_id, process_ts, row_count FROM r WHERE process_ts > (SELECT min(process_ts) + 86400000 FROM r)")
def warmup_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.after_warm_up(results(spark, sf_dir), 24 * HOUR).select("ad_id", "process_ts", "row_count")


@query(f"WITH {_RESULTS} SELECT w_start, min(final_ts - event_ts) AS event_latency, min(final_ts - process_ts) AS processing_latency FROM r GROUP BY ALL")
def latency_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.min_latency(results(spark, sf_dir), "w_start")


@query(f"WITH {_RESULTS} SELECT w_start, CAST(sum(row_count) * 2 / 5 AS DOUBLE) AS throughput FROM r GROUP BY ALL")
def throughput_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.throughput_by(results(spark, sf_dir), "w_start")


@query(f"WITH {_RESULTS} SELECT ad_id, w_start, final_ts - lag(final_ts) OVER (PARTITION BY ad_id ORDER BY w_start) AS delta FROM r")
def row_delta_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.row_deltas(results(spark, sf_dir), ["ad_id"], ["w_start"], "final_ts").select("ad_id", "w_start", "delta")


_RUNS = "runs AS (SELECT o_orderpriority AS engine, o_orderkey % 5 AS run, CAST(count(*) AS DOUBLE) AS seconds FROM orders GROUP BY ALL)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("engine"), (F.col("o_orderkey") % 5).alias("run")).agg(F.count("*").cast("double").alias("seconds"))


@query(f"WITH {_RUNS} SELECT engine, round(avg(seconds), 6) AS mean, round(stddev_samp(seconds) / sqrt(count(*)) * 2.776, 6) AS half_width FROM runs GROUP BY ALL")
def mean_ci95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.mean_ci95(_runs(spark, sf_dir), "seconds", "engine").select("engine", F.round("mean", 6).alias("mean"), F.round("half_width", 6).alias("half_width"))


@query("WITH m AS (SELECT CAST(1 + o_orderkey % 4 AS BIGINT) AS nodes, max(o_totalprice) AS mean FROM orders GROUP BY ALL) SELECT nodes, mean, round((SELECT mean FROM m WHERE nodes = 1) / nodes, 6) AS ideal FROM m")
def ideal_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "orders").groupBy((1 + F.col("o_orderkey") % 4).alias("nodes")).agg(F.max("o_totalprice").alias("mean"))
    return analytics.ideal_scaling(means).withColumn("ideal", F.round("ideal", 6))


@query(f"""WITH RECURSIVE {_RESULTS},
o AS (SELECT CAST(w_start AS DATE) AS day, ad_id, final_ts, row_count, row_number() OVER (PARTITION BY CAST(w_start AS DATE) ORDER BY final_ts, ad_id) AS i FROM r),
f AS (
  SELECT day, ad_id, final_ts, row_count, i, 5 AS w, [ad_id] AS seen FROM o WHERE i = 1
  UNION ALL
  SELECT o.day, o.ad_id, o.final_ts, o.row_count, o.i, CASE WHEN list_contains(f.seen, o.ad_id) THEN f.w + 1 ELSE f.w END,
         CASE WHEN list_contains(f.seen, o.ad_id) THEN [o.ad_id] ELSE list_append(f.seen, o.ad_id) END
  FROM f JOIN o ON o.day = f.day AND o.i = f.i + 1)
SELECT day, ad_id, final_ts, CAST(row_count AS BIGINT) AS row_count, w AS "window" FROM f""")
def detected_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows found again from the order of output rows, each day of output a run of its own."""
    r = results(spark, sf_dir).withColumn("day", F.to_date("w_start")).select("day", "ad_id", "final_ts", "row_count")
    return analytics.detect_windows(r, "day", "final_ts")


def _sweep(keys: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keyed = lambda df: df.withColumn("ad_id", (F.col("user_id") % keys).cast("int"))
        return profit_by_window(keyed(ads(spark, sf_dir)), keyed(checkouts(spark, sf_dir)), SIZE, SLIDE)

    run.__name__ = f"key_sweep_{keys}"
    return run


for _n in (10, 100, 1000):
    query(f"WITH {_PROFIT} SELECT w_start, ad_id, profit, max_ts, CAST(n_ads AS BIGINT) AS n_ads FROM profit".replace("user_id, ad_id, value AS amount", f"user_id, CAST(user_id % {_n} AS INTEGER) AS ad_id, value AS amount"))(_sweep(_n))


#: Windows of the sweep over many keys: lines cost, orders bring value.
_MONTH = 30 * 24 * HOUR


def _wide_sweep(keys: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        side = lambda name, ts, key, amount: table(spark, sf_dir, name).select(F.col(ts).alias("ts"), (F.col(key) % keys).cast("int").alias("ad_id"), F.col(amount).alias("amount"))
        return profit_by_window(side("lineitem", "l_shipdate", "l_orderkey", "l_extendedprice"), side("orders", "o_orderdate", "o_orderkey", "o_totalprice"), 5 * _MONTH, _MONTH)

    run.__name__ = f"key_sweep_{keys}"
    return run


_WIDE = """WITH ads AS (SELECT l_shipdate AS ts, CAST(l_orderkey % {n} AS INTEGER) AS ad_id, l_extendedprice AS amount FROM lineitem),
checkouts AS (SELECT o_orderdate AS ts, CAST(o_orderkey % {n} AS INTEGER) AS ad_id, o_totalprice AS amount FROM orders WHERE o_orderkey % {n} <> 0),
k AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
a AS (SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 DAY AS w_start, ad_id, sum(CAST(amount AS DECIMAL(18,2))) AS cost, max(ts) AS ts, count(*) AS n FROM ads, k GROUP BY ALL),
c AS (SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 DAY AS w_start, ad_id, sum(CAST(amount AS DECIMAL(18,2))) AS value, max(ts) AS ts FROM checkouts, k GROUP BY ALL)
SELECT a.w_start, a.ad_id, CAST(c.value - a.cost AS DOUBLE) AS profit, greatest(a.ts, c.ts) AS max_ts, CAST(a.n AS BIGINT) AS n_ads FROM a JOIN c ON a.w_start = c.w_start AND a.ad_id = c.ad_id"""
for _n in (10_000, 100_000, 1_000_000):
    query(_WIDE.format(n=_n))(_wide_sweep(_n))


# ---------------------------------------------------------------- pipelines


@query(f"WITH {_PROFIT} SELECT epoch_ms(w_start) AS w_start, ad_id, profit, CAST(epoch_us(max_ts) // 1000 AS BIGINT) AS event_ts, CAST(n_ads AS BIGINT) AS row_count, true AS stamped FROM profit")
def pipeline_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profit query as a pipeline of operators over lines, with windows of panes."""

    def read(rows: DataFrame, *columns: Column) -> Callable[[SparkSession], DataFrame]:
        return lambda _: rows.select(F.concat_ws(",", *[c.cast("string") for c in columns]).alias("value"), F.timestamp_millis(millis(F.col("ts"))).alias("arrival"))

    one, user, ad, amount, at = F.lit(0), F.col("user_id"), F.col("ad_id"), money(F.col("amount")), millis(F.col("ts"))
    q = profit_query(read(ads(spark, sf_dir), ad, user, amount, at), read(checkouts(spark, sf_dir), one, user, ad, amount, at), HOUR, 5, panes=True)
    rows = (q.joined | dsl.rows_output(*q.output)).run(spark)
    return rows.select(F.unix_millis("w_start").alias("w_start"), "ad_id", F.round("profit", 2).alias("profit"), "event_ts", "row_count", ((F.col("process_ts") > 0) & (F.col("final_ts") >= F.col("process_ts"))).alias("stamped"))
