import datetime as dt

from signalmill.streaming import windows as S

T0 = dt.datetime(2026, 1, 1)


def test_a_count_beyond_array_size_stays_one_row(spark):
    rows = [("m", T0, 1.0, 5 * 10**9), ("m", T0, 2.0, 10**9), ("m", T0, 2.0, 3 * 10**9), ("m", T0, 7.0, 10**9), ("o", T0, 1.0, 1), ("o", T0, 2.0, 2), ("o", T0, None, 4)]
    counts = spark.createDataFrame(rows, "metric string, start timestamp_ntz, value double, n bigint")
    out = S.stored_percentiles(counts, ["metric"])
    assert {r.metric: (r.n, r.p50, r.p95) for r in out.collect()} == {"m": (10**10, 1.5, 7.0), "o": (3, 2.0, 2.0)}
    assert "Generate explode" not in out._jdf.queryExecution().toString()
