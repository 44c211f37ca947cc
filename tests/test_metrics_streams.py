import datetime as dt

import pytest
from pyspark.sql import functions as F

from signalmill.operators import metrics as M
from signalmill.session import scratch_path
from signalmill.sources.landed import KeyedTable
from signalmill.streaming import queue as Q
from signalmill.streaming import triggers as G
from signalmill.streaming import windows as S

T0 = dt.datetime(2026, 1, 1)
ROW = "ts timestamp_ntz, metric string, value double"


def metrics(spark, points):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=m), name, float(v)) for m, name, v in points], ROW)


def test_alarm_needs_two_adjacent_breaches(spark):
    name = "IngestionFailures"
    points = [(0, name, 3), (5, name, 2), (10, name, 3), (16, name, 1), (17, name, 2), (20, name, 5), (25, name, 0),
              (30, name, 9), (40, name, 9), (45, name, 9)]
    got = {r.start: (r.breaching, r.state, r.changed) for r in M.alarms(metrics(spark, points)).collect()}
    at = lambda m: got[T0 + dt.timedelta(minutes=m)]
    assert at(0) == (True, "OK", False) and at(5) == (False, "OK", False)
    assert at(10) == (True, "OK", False) and at(15) == (True, "ALARM", True) and at(20) == (True, "ALARM", False)
    assert at(25) == (False, "OK", True)
    assert at(30) == (True, "OK", False) and at(40) == (True, "OK", False) and at(45) == (True, "ALARM", True)


def test_latency_alarm_is_strict(spark):
    points = [(m, "AgentLatencyMs", 30000) for m in (0, 5)] + [(m, "AgentLatencyMs", 30001) for m in (10, 15)]
    states = [r.state for r in M.alarms(metrics(spark, points)).orderBy("start").collect()]
    assert states == ["OK", "OK", "OK", "ALARM"]


def test_dimensions_always_hold_the_environment(spark):
    rows = spark.createDataFrame([(T0, "A", "BULLISH")], "ts timestamp, agent_name string, direction string")
    got = M.signals_emitted(rows, "prod").select("name", "unit", M.dims_text(M.F.col("dims"))).first()
    assert tuple(got) == ("SignalsEmitted", "Count", "Agent=A;Direction=BULLISH;Environment=prod")


def test_percentiles_interpolate_per_window(spark):
    points = [(m, "AgentLatencyMs", v) for m, v in ((0, 1), (1, 2), (2, 10), (20, 7))]
    got = [(r.n, r.p50, r.p95) for r in M.windowed_percentiles(metrics(spark, points), ["metric"]).orderBy("start").collect()]
    assert got == [(3, 2.0, pytest.approx(9.2)), (1, 7.0, 7.0)]


def test_stream_equals_batch_and_append_leaves_open_windows_out(spark):
    points = [(m, "m", 1) for m in range(0, 120, 4)]
    df = metrics(spark, points)
    landing = scratch_path(spark, "metrics")
    df.write.parquet(landing)
    batch = {(r.start, r.total) for r in M.windowed_sums(df, ["metric"]).collect()}

    def run(mode):
        out = scratch_path(spark, "windows")
        stream = spark.readStream.schema(ROW).parquet(landing)
        S.store_windows(S.stream_sums(stream, ["metric"]), scratch_path(spark, "state"), out, mode=mode)
        return {(r.start, r.total) for r in S.read_keyed(spark, out, S.WINDOW_ROWS, ["metric", "start"]).collect()}

    assert run("complete") == batch
    closed = run("append")
    assert closed < batch and len(closed) == len(batch) - 1


def test_queue_ends_bad_messages_after_the_limit_and_is_restartable(spark):
    landing, out, state = (scratch_path(spark, n) for n in ("queue", "out", "state"))
    rows = [("good", 1, '{"event_type": "new_snapshot", "date": "2026-01-01", "s3_key": "k"}'), ("bad", 1, "{oops"), ("list", 1, "[1]"), ("null", 1, None)]
    spark.createDataFrame(rows, Q.MESSAGE).write.json(landing)
    rounds = 0
    Q.consume(spark, landing, out, state, max_receives=2)
    while Q.reland(spark, out, landing):
        rounds += 1
        Q.consume(spark, landing, out, state, max_receives=2)
    Q.consume(spark, landing, out, state, max_receives=2)  # nothing new
    got = {r.message_id: (r.status, r.attempt) for r in Q.outcome(spark, out).collect()}
    assert got == {"good": ("ok", 1), "bad": ("dead", 2), "list": ("dead", 2), "null": ("dead", 2)} and rounds == 1


def test_new_files_are_picked_up_once(spark):
    source, table, state = (scratch_path(spark, n) for n in ("src", "cat", "state"))
    schema = "symbol string, close double, date string"
    seen = []
    for day in ("2026-01-01", "2026-01-02"):
        spark.createDataFrame([("A", 1.0, day)], schema).write.mode("append").partitionBy("date").parquet(source)
        G.catalog_new(spark, source, table, state, schema)
        seen.append(spark.read.schema(schema + ", batch bigint").option("basePath", table).parquet(table).count())
    assert seen == [1, 2]


def test_notify_never_fails_the_run(spark, caplog):
    G.notify(spark.range(1), "/nowhere", 0)
    assert "notification skipped" in caplog.text


def test_schema_changes_are_named(spark):
    source = scratch_path(spark, "src")
    spark.range(1).selectExpr("'A' AS symbol", "1 AS close", "2 AS extra").write.parquet(source)
    got = G.schema_changes(spark, [source], "symbol string, close double, gone int, date string", folders=("date",))
    assert got == ["new column extra", "missing column gone", "column close is int"]
    spark.range(1).selectExpr("'A' AS symbol", "'x' AS close", "2 AS extra").write.mode("append").parquet(source)
    assert G.schema_changes(spark, [source], "symbol string, close double")[0].startswith("files disagree")


def test_only_the_files_of_a_micro_batch_are_looked_at(spark, caplog):
    source, table, state = (scratch_path(spark, n) for n in ("src", "cat", "state"))
    schema = "symbol string, close double, date string"
    for day, extra in (("2026-01-01", "1 AS odd"), ("2026-01-02", "2 AS odd"), ("2026-01-03", None)):
        rows = spark.range(1).selectExpr("'A' AS symbol", "1d AS close", f"'{day}' AS date", *([extra] if extra else []))
        rows.write.mode("append").partitionBy("date").parquet(source)
        caplog.clear()
        G.catalog_new(spark, source, table, state, schema)
        assert ("new column odd" in caplog.text) == bool(extra)
    assert spark.read.schema(schema + ", batch bigint").option("basePath", table).parquet(table).count() == 3


def dims_rows(spark):
    rows = [
        (name, float(v), T0 + dt.timedelta(minutes=m), dims)
        for m, name, v, dims in [
            (0, "L", 1, {"A": "x", "E": "d"}), (1, "L", 9, {"A": "y", "E": "d"}), (4, "L", 1, {"A": "x", "E": "p"}), (6, "L", 5, {"A": "x"}), (16, "L", 7, None),
            (2, "S", 3, {"A": "x"}), (2, "S", float("nan"), {"A": "x"}),
        ]
    ] + [("S", None, T0, {"A": "x"})]
    return spark.createDataFrame(rows, "name string, value double, timestamp timestamp_ntz, dims map<string,string>")


def test_statistics_over_any_dimensions(spark):
    counts = M.value_counts(dims_rows(spark))
    at = lambda m: T0 + dt.timedelta(minutes=m)
    got = {(r["name"], r.start): (r.SampleCount, r.Sum, r.Average, r.Minimum, r.Maximum, r.p50) for r in M.statistics(counts, ["Sum", "Average", "Minimum", "Maximum", "p50"], seconds=900).collect()}
    assert got == {("L", at(0)): (4, 16.0, 4.0, 1.0, 9.0, 3.0), ("L", at(15)): (1, 7.0, 7.0, 7.0, 7.0, 7.0), ("S", at(0)): (1, 3.0, 3.0, 3.0, 3.0, 3.0)}
    by = {(r.A, r.start): r.Sum for r in M.statistics(counts.where("name = 'L'"), ["Sum"], ["A"]).collect()}
    assert by == {("x", at(0)): 2.0, ("y", at(0)): 9.0, ("x", at(5)): 5.0, (None, at(15)): 7.0}
    some = M.statistics(counts, ["p95"], where={"A": "x", "E": "d"}).collect()
    assert [(r["name"], r.SampleCount, r.p95) for r in some] == [("L", 1, 1.0)]
    with pytest.raises(ValueError, match="Median"):
        M.statistics(counts, ["Median"])


def test_alarms_on_rows_with_a_percentile_and_a_dimension(spark):
    rows = [("L", v, T0 + dt.timedelta(minutes=m), {"A": a}) for m, v, a in [(0, 9.0, "x"), (1, 1.0, "x"), (5, 9.0, "x"), (6, 9.0, "y"), (10, 1.0, "x"), (11, 99.0, "y")]]
    df = spark.createDataFrame(rows, "name string, value double, timestamp timestamp_ntz, dims map<string,string>")
    got = [r.state for r in M.row_alarms(df, [M.Alarm("L", 8.0, True, "p95")]).orderBy("start").collect()]
    assert got == ["OK", "ALARM", "ALARM"]
    assert [r.state for r in M.row_alarms(df, [M.Alarm("L", 9.0, False, "Sum", (("A", "x"),))]).orderBy("start").collect()] == ["OK", "ALARM", "OK"]


def test_new_periods_are_judged_with_the_last_two_only(spark):
    name = "IngestionFailures"
    points = [(5 * i, name, v) for i, v in enumerate([3, 3, 1, 9, 9, 9, 0, 4, 4]) if i != 7]
    every = M.windowed_sums(metrics(spark, points), ["metric"], 300).select("metric", "start", "total")
    want = {r.start: (r.state, r.changed) for r in M.evaluated(every).collect()}
    starts = sorted(want)
    for cut in range(1, len(starts)):
        old, new = every.where(every.start < starts[cut]), every.where(every.start >= starts[cut])
        got = {r.start: (r.state, r.changed) for r in M.evaluated_after(M.last_periods(old), new).collect()}
        assert got == {s: want[s] for s in starts[cut:]}, cut


def test_an_alarm_ends_in_the_first_period_without_data(spark):
    name = "IngestionFailures"
    rows = M.alarms(metrics(spark, [(0, name, 3), (5, name, 3), (15, name, 3), (20, name, 3)]))
    at = lambda m: T0 + dt.timedelta(minutes=m)
    ended = lambda m: sorted(r.start for r in M.closings(rows, F.lit(at(m))).collect())
    assert ended(12) == [] and ended(15) == [at(10)] and ended(60) == [at(10), at(25)]


def test_stream_alarms_judge_each_window_once_and_restart(spark):
    landing, state, out = (scratch_path(spark, n) for n in ("rows", "state", "out"))
    kind = "name string, value double, timestamp timestamp_ntz, dims map<string,string>"
    values = [5, 5, 0, 9, 9, 9, 1, 8, 8, 8, 0, 0, 0]
    rows = [("X", float(v), T0 + dt.timedelta(minutes=5 * i), {"A": "x"}) for i, v in enumerate(values)]
    rules = [M.Alarm("X", 5.0)]
    for part in (rows[:3], rows[3:5], rows[5:9], rows[9:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(landing)
        S.watch_alarms(S.stream_metric_counts(spark.readStream.schema(kind).parquet(landing)), state, out, rules)
    got = [(r.start, r.state, r.changed) for r in S.judged_alarms(spark, out).orderBy("start").collect()]
    want = [(r.start, r.state, r.changed) for r in M.row_alarms(spark.createDataFrame(rows, kind), rules).orderBy("start").collect()]
    assert got == want[:len(got)] and len(got) >= len(want) - 3 and len({s for s, *_ in got}) == len(got)


def test_a_snapshot_delivered_twice_is_decided_once(spark):
    landing, state = scratch_path(spark, "snap"), scratch_path(spark, "state")
    kind = "date string, source string, s3_raw_key string"
    table = KeyedTable(spark, scratch_path(spark, "recs"), "date string, run_id int, n bigint", ["date", "run_id"])
    asked = []

    def decide(dates):
        asked.append(sorted(r.date for r in dates.collect()))
        return dates.selectExpr("date", "1 AS run_id", f"{len(asked)}L AS n")

    for days in (["2026-01-01", "2026-01-01", "2026-01-02"], ["2026-01-02", "2026-01-03"]):
        spark.createDataFrame([(d, "combined", "k") for d in days], kind).write.mode("append").json(landing)
        G.decide_on_snapshots(spark, landing, state, kind, decide, table)
    assert asked == [["2026-01-01", "2026-01-02"], ["2026-01-02", "2026-01-03"]]
    assert sorted(map(tuple, table.read().select("date", "n").collect())) == [("2026-01-01", 1), ("2026-01-02", 2), ("2026-01-03", 2)]


def test_lines_that_are_no_messages_end_as_dead_letters(spark):
    landing, out, state = (scratch_path(spark, n) for n in ("queue", "out", "state"))
    lines = ["{not json", "plain text", "", "[1, 2]", '{"message_id": "a", "body": "{\\"event_type\\": \\"x\\"}"}',
             '{"message_id": "b", "attempt": null, "body": "bad"}', '{"attempt": 1, "body": "bad too"}', '{"message_id": "c"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(landing)
    rounds = 0
    Q.consume(spark, landing, out, state, max_receives=3)
    while Q.reland(spark, out, landing):
        rounds += 1
        assert rounds < 5
        Q.consume(spark, landing, out, state, max_receives=3)
    got = sorted((r.message_id[:5], r.status, r.attempt) for r in Q.outcome(spark, out).collect())
    assert got == [("a", "ok", 1), ("b", "dead", 3), ("c", "dead", 3)] + [("line:", "dead", 3)] * 4
