import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slidestream import analytics
from slidestream.fields import AggSchema, Field, Schema
from slidestream.functions.scalar import diff, fixed, greater, translated
from slidestream.operators import aggregate, exchange, filters, joins, parse, project, windows
from slidestream.sources import batch, generator


def test_fields_are_identities():
    a, b = Field("t", "int"), Field("t", "int")
    assert a.column != b.column and a != b
    with pytest.raises(ValueError, match="twice"):
        Schema.of(a, a)
    with pytest.raises(ValueError, match="isn't among"):
        Schema.of(a).require(b)
    with pytest.raises(ValueError, match="unknown type"):
        Field("t", "decimal")


def test_aggregation_needs_a_key_and_known_kinds():
    f = Field("a", "int")
    with pytest.raises(ValueError, match="needs a key"):
        AggSchema.of((f, "sum"))
    with pytest.raises(ValueError, match="unknown aggregation"):
        AggSchema.of((f, "median"))


def test_filter_keeps_all_or_some(spark):
    df = batch.constants(spark, [1, 2, 3])
    assert [r.value for r in filters.keep_if(df, "value < 10").collect()] == [1, 2, 3]
    assert [r.value for r in filters.keep_if(df, F.col("value") > 2).collect()] == [3]
    assert filters.drop_if(df, "value", "== 2 || value == 3").count() == 1


def test_drop_if_keeps_nulls(spark):
    df = spark.createDataFrame([(0,), (None,), (5,)], "a int")
    assert sorted(str(r.a) for r in filters.drop_if(df, "a", "== 0").collect()) == ["5", "None"]


def test_translation():
    assert translated("a == 1 && !(b != 2) || c == '&&'") == "a == 1  AND   NOT (b != 2)  OR  c == '&&'"


def test_parse(spark):
    a, b, c = Field("a", "int"), Field("b", "double"), Field("c", "uint64")
    lines = ["1,2.5,3", "-4,10,5", " 7 , 1e2 ,9", "x,1,2", "1,2", "1,2,3,4", "", None, "1,,3"]
    parsed = parse.parse_csv(batch.constants(spark, lines, "string"), Schema.of(a, b, c))
    good = sorted(tuple(r) for r in project.project(parse.accepted(parsed), a, b, c).collect())
    assert good == [(-4, 10.0, 5), (1, 2.5, 3), (7, 100.0, 9)]
    assert sorted(r[0] for r in parse.rejected(parsed).collect()) == ["", "", "1,,3", "1,2", "1,2,3,4", "x,1,2"]


def test_append_and_combine(spark):
    a, b, one, d, m, t = Field("a", "int"), Field("b", "double"), Field("one", "uint64"), Field("d", "double"), Field("m", "double"), Field("t", "uint64")
    df = spark.createDataFrame([(1, 2.5), (4, None)], f"{a.column} int, {b.column} double")
    df = project.append_timestamp(project.combine(project.combine(project.append(df, one, "1"), d, b, a, diff), m, a, b, greater), t)
    rows = sorted(tuple(r) for r in project.project(df, a, one, d, m).collect())
    assert rows == [(1, 1, 1.5, 2.5), (4, 1, None, 4.0)]
    assert df.select(t.column).distinct().count() == 1


def test_tokens(spark, tmp_path):
    assert [r.value for r in batch.tokens(spark, io.StringIO("1 2\n\n x 3"), "int").collect()] == [1, 2, None, 3]
    (tmp_path / "t.txt").write_text("a  b\n\nc\n")
    assert [r.value for r in batch.file_tokens(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b", "c"]
    assert batch.constants(spark, [], "int").count() == 0


def test_config(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ad_id_range_first,ad_id_range_second,cost_range_first,cost_range_second\n1,5,10,20\n")
    assert generator.ranges_of(batch.config(spark, str(tmp_path / "c.csv"))) == {"ad_id": (1, 5), "cost": (10, 20)}


def test_json_events(spark):
    lines = batch.constants(spark, ['{"key":"DE","value":"12","ts":"5"}', "broken"], "string")
    assert [tuple(r) for r in batch.json_events(lines).collect()] == [("DE", 12, 5), (None, None, None)]


def test_generator_is_repeatable(spark):
    one, two = (generator.ads(spark, 1000, event_time=F.lit(0)).collect() for _ in range(2))
    assert one == two and len({r.ad_id for r in one}) > 500
    assert generator.wire(generator.checkouts(spark, 3, event_time=F.lit(7))).collect()[0].value.count(",") == 4


def test_pace():
    lines = [str(k) for k in range(10)]
    assert [len(b) for b in generator.Pace(2).bursts(lines)] == [2] * 5
    spikes = generator.Pace(2, 0, 7, 3)  # seven lines in large bursts, seven in normal ones
    assert [len(b) for b in spikes.bursts(range(30))] == [6, 1, 2, 2, 2, 1, 6, 1, 2, 2, 2, 1, 2]
    assert generator.megabytes_rate(1.0, 100).burst == 1000 and next(generator.megabytes_rate(0, 1).bursts(lines)) == lines


@pytest.mark.parametrize("pace", [(2, 0, 0, 1), (2, 0, 7, 3), (3, 0, 100, 5), (5, 0, 3, 2), (1, 0, 1, 1)])
def test_arrival_is_the_burst(spark, pace):
    p = generator.Pace(*pace)
    want = [n for n, b in enumerate(p.bursts(range(1000))) for _ in b]
    got = spark.range(1000).select("id", generator.arrival_second(F.col("id"), p).alias("s")).orderBy("id").collect()
    assert [r.s for r in got] == want


def test_positions(spark):
    rows = [(k * 37 % 1000 // 3, k) for k in range(1000)]
    got = exchange.with_positions(spark.createDataFrame(rows, "a int, b int").repartition(7), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.position)] == sorted(rows) and sorted(r.position for r in got) == list(range(1000))


def test_window_must_be_a_multiple():
    with pytest.raises(ValueError, match="multiple"):
        windows.check(2500, 1000)


def test_noop_is_first_arrival_and_min_is_min(spark):
    k, a, b = Field("k", "int"), Field("a", "int"), Field("b", "int")
    df = spark.createDataFrame([(1, 5, 3, 2), (1, 7, 9, 1), (2, 1, 1, 5)], f"{k.column} int, {a.column} int, {b.column} int, seen int")
    out = aggregate.aggregate(df, AggSchema.of((k, "key"), (a, "noop"), (b, "min")), arrival="seen")
    assert sorted(tuple(r) for r in project.project(out, k, a, b).collect()) == [(1, 7, 3), (2, 1, 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30_000), st.integers(-2, 2), st.integers(-100, 100)), max_size=40), st.sampled_from([(5000, 1000), (3000, 3000), (4000, 500)]))
def test_panes_equal_windows(spark, rows, sizes):
    key, total, low, high, first = Field("k", "int"), Field("total", "long"), Field("low", "long"), Field("high", "long"), Field("first", "long")
    df = spark.createDataFrame([(t, k, v, n) for n, (t, k, v) in enumerate(rows)], "ms long, k int, v long, seen long")
    df = df.select(F.timestamp_millis("ms").alias("ts"), F.col("k").alias(key.column), *[F.col("v").alias(f.column) for f in (total, low, high, first)], "seen")
    spec = AggSchema.of((key, "key"), (total, "sum"), (low, "min"), (high, "max"), (first, "noop"))
    one, two = (run(df, "ts", *sizes, spec, "seen").select("w_start", "w_end", *[f.column for f in (key, total, low, high, first)]) for run in (windows.sliding_aggregate, windows.pane_aggregate))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, l string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "j int, r string")
    assert joins.multi_join(a, b, "k", "j").count() == 4
    t = spark.createDataFrame([(1, 1), (2, 1), (1, 2)], "a int, b int").select(joins.of_latest(F.col("a"), F.col("b"), F.lit("l"), F.lit("r")).alias("s"))
    assert [r.s for r in t.collect()] == ["r", "l", "r"]


def test_exchange(spark):
    df = spark.createDataFrame([(k,) for k in range(-50, 50)], "k int")
    parts = exchange.hash_partition(df, 3, "k").select("k", F.spark_partition_id().alias("p"))
    assert parts.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()
    assert exchange.union_ranks([exchange.in_rank(df, "k", r, 3) for r in range(3)]).count() == 100
    with pytest.raises(ValueError):
        exchange.union_ranks([])


def test_six_decimals(spark):
    df = spark.createDataFrame([(0.67, 1)], "a double, b int")
    from slidestream.sinks.text import lines

    assert lines(df).first().value == "0.670000,1"
    assert df.select(fixed(F.col("a"), 2)).first()[0] == "0.67"


def results(spark):
    rows = [(0, 1, 1, 1, 99), (1, 1000, 1100, 6000, 10), (2, 2000, 2600, 6000, 5), (1, 2500, 2600, 7200, 20), (2, 2500, 7000, 7200, 5)]
    return spark.createDataFrame(rows, "ad_id int, event_ts long, process_ts long, final_ts long, row_count long")


def test_analytics(spark):
    r = analytics.with_elapsed(results(spark))
    assert {(x.elapsed, x.event_latency, x.processing_latency) for x in analytics.min_latency(r, "elapsed").collect()} == {(5000, 4000, 3400), (6200, 4700, 200)}
    assert {(x.bucket, x.throughput) for x in analytics.throughput_buckets(r).collect()} == {(5000, 6.0), (6000, 10.0)}
    assert analytics.runtime(r).first().seconds == 6.2
    assert analytics.average_throughput(r).first().throughput == pytest.approx(40 * 1000 * 2 / 5 / 6200)
    assert analytics.after_warm_up(r).count() == 1
    runs = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,)], "s double")
    got = analytics.mean_ci95(runs, "s").first()
    assert got["mean"] == 3.0 and got.half_width == pytest.approx(2.5**0.5 / 5**0.5 * 2.776)
    means = spark.createDataFrame([(1, 8.0), (4, 3.0)], "nodes int, mean double")
    assert {(x.nodes, x.ideal) for x in analytics.ideal_scaling(means).collect()} == {(1, 8.0), (4, 2.0)}


def test_window_detection_and_deltas(spark):
    df = spark.createDataFrame([("r", 1, 10), ("r", 2, 10), ("r", 1, 20), ("r", 3, 20), ("r", 1, 30)], "run string, ad_id int, t int")
    got = sorted((x.t, x.ad_id, x.window) for x in analytics.detect_windows(df, "run", "t").collect())
    assert got == [(10, 1, 5), (10, 2, 5), (20, 1, 6), (20, 3, 6), (30, 1, 7)]
    deltas = analytics.row_deltas(df, ["ad_id"], ["t"], "t")
    assert sorted((x.ad_id, x.t, x.delta) for x in deltas.where("ad_id = 1").collect()) == [(1, 10, None), (1, 20, 10), (1, 30, 10)]
    assert list(analytics.delta_faults([(1, 0), (1, 50), (2, 1000), (2, 1500), (3, 5000)])) == [3, 4]
    assert analytics.same_rows(df, df) and not analytics.same_rows(df, df.limit(1))


def test_confidence_interval_of_many_runs(spark):
    """Printed 97.5 % quantiles of Student's t; one run and none with a value have no interval."""
    quantiles = {2: 12.706, 11: 2.228, 12: 2.201, 13: 2.179, 21: 2.086, 31: 2.042, 61: 2.000, 121: 1.980}
    rows = [(n, float(k)) for n in quantiles for k in range(n)] + [(1, 5.0), (0, None)]
    got = {r.n: r for r in analytics.mean_ci95(spark.createDataFrame(rows, "n int, s double"), "s", "n").collect()}
    for n, t in quantiles.items():
        assert got[n]["mean"] == pytest.approx((n - 1) / 2)
        assert got[n].half_width / (n * (n + 1) / 12 / n) ** 0.5 == pytest.approx(t, abs=0.0006), n
    assert got[1].half_width is None and got[0].half_width is None
