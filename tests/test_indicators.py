import datetime as dt
import math
import random

import pandas as pd
import pytest

from signalmill.operators import bars as B
from signalmill.operators import indicators as I


def history(symbol, n, seed=1, start=dt.datetime(2024, 1, 1), step=3600):
    rng = random.Random(seed)
    price, rows = 50.0, []
    for i in range(n):
        price = max(1.0, price + rng.uniform(-2, 2))
        rows.append((symbol, start + dt.timedelta(seconds=step * i), round(price, 2)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


def expected(close):
    """Recursive definitions, straight from pandas."""
    close = pd.Series(close)
    diff = close.diff()
    up, down = diff.where(diff > 0, 0.0), -diff.where(diff < 0, 0.0)
    smooth = dict(alpha=1 / 14, min_periods=14, adjust=False)
    gain, loss = up.ewm(**smooth).mean(), down.ewm(**smooth).mean()
    line = close.ewm(span=12, min_periods=12, adjust=False).mean() - close.ewm(span=26, min_periods=26, adjust=False).mean()
    signal = line.ewm(span=9, min_periods=9, adjust=False).mean()
    mid, dev = close.rolling(20).mean(), close.rolling(20).std(ddof=0)
    return pd.DataFrame({
        "rsi": 100 - 100 / (1 + gain / loss), "macd": line, "macd_signal": signal, "macd_hist": line - signal,
        "bb_high": mid + 2 * dev, "bb_mid": mid, "bb_low": mid - 2 * dev,
    })


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 700, "slice_seconds": 86_400}, {"block_rows": 68}])
def test_series_equals_the_recursion_across_blocks(spark, blocks):
    hot, cold = history("HOT", 3000, 1), history("COLD", 40, 2)
    got = I.indicator_series(frame(spark, hot + cold).repartition(7), **blocks).toPandas()
    assert len(got) == 3040
    for symbol, rows in (("HOT", hot), ("COLD", cold)):
        mine = got[got.symbol == symbol].sort_values("ts").reset_index(drop=True)
        assert mine.rn.tolist() == list(range(1, len(rows) + 1))
        want = expected([r[2] for r in rows])
        for column in want:
            assert (mine[column].isna() == want[column].isna()).all(), column
            assert (mine[column] - want[column]).abs().max() < 1e-9, column


def test_latest_equals_last_row_of_series(spark):
    df = frame(spark, history("A", 2000, 3) + history("B", 30, 4) + history("C", 10, 5))
    latest = {r.symbol: r for r in I.indicator_latest(df).collect()}
    series = I.indicator_series(df).toPandas()
    for symbol in "ABC":
        last = series[series.symbol == symbol].sort_values("ts").iloc[-1]
        for column in I.INDICATORS:
            mine = getattr(latest[symbol], column)
            assert (mine is None) == (pd.isna(last[column]))
            assert mine is None or mine == pytest.approx(last[column], abs=1e-9)


def test_warm_up_rows_are_null(spark):
    rows = {r.rn: r for r in I.indicator_series(frame(spark, history("A", 40))).collect()}
    for first, column in ((14, "rsi"), (20, "bb_mid"), (26, "macd"), (34, "macd_signal"), (34, "macd_hist")):
        assert rows[first - 1][column] is None and rows[first][column] is not None


def test_between_26_and_33_bars_the_histogram_adds_nothing(spark):
    record = I.indicator_records(frame(spark, history("A", 30))).first()
    assert record.macd is not None and record.macd_hist is None
    assert not any("MACD" in s for s in record.ta_signals)


def test_too_few_bars_drop_out_and_null_closes_do_not_count(spark):
    rows = history("A", 26) + [("A", dt.datetime(2025, 1, 1), None), ("A", dt.datetime(2025, 1, 2), float("nan"))] + history("B", 25)
    df = frame(spark, rows)
    assert [r.symbol for r in I.indicator_records(df).collect()] == ["A"]
    assert {r.symbol: (r.n_close, r.status) for r in I.history_gate(df).collect()} == {
        "A": (26, "ok"), "B": (25, "insufficient data"),
    }


def test_rising_prices_are_overbought(spark):
    rows = [("UP", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i) for i in range(60)]
    record = I.indicator_records(frame(spark, rows)).first()
    assert record.rsi == 100.0
    assert record.ta_signals[0] == "RSI overbought (100.0)"


def scored(spark, **values):
    base = dict(symbol="A", close=50.0, n=40, rsi=50.0, macd=0.0, macd_signal=0.0, macd_hist=0.0, bb_high=60.0, bb_mid=50.0, bb_low=40.0)
    base.update(values)
    schema = "symbol string, close double, n bigint, rsi double, macd double, macd_signal double, macd_hist double, bb_high double, bb_mid double, bb_low double"
    return I.scored(spark.createDataFrame([tuple(base.values())], schema)).first()


def test_score_limits_are_strict(spark):
    assert scored(spark).ta_score == 0
    assert scored(spark, rsi=30.0).ta_score == 0
    assert scored(spark, rsi=29.9).ta_signals == ["RSI oversold (29.9)"]
    assert scored(spark, rsi=70.1).ta_score == -2
    assert scored(spark, macd_hist=0.1, macd=0.2, macd_signal=0.1).ta_score == 1
    assert scored(spark, macd_hist=0.1, macd=0.1, macd_signal=0.1).ta_score == 0
    assert scored(spark, macd_hist=-0.1).ta_signals[1] == "MACD bearish"
    row = scored(spark, rsi=20.0, close=39.0, macd_hist=0.2, macd=0.2)
    assert row.ta_score == 4 and row.ta_signals[-1] == "Price below lower Bollinger Band (oversold)"
    assert scored(spark, close=61.0).ta_score == -1


def test_direction_and_best_asset(spark):
    rows = spark.createDataFrame([("XLE", 1), ("CVX", -2), ("USO", 2)], "symbol string, ta_score int")
    direction = I.direction_by_score(rows).first()
    assert (direction.total_score, direction.direction) == (1, "NEUTRAL")
    assert I.best_asset(rows, ["XLE", "XOM", "CVX", "USO", "UNG"]).first()[0] == "CVX"
    assert I.best_asset(rows, ["USO", "CVX"]).first()[0] == "USO"
    assert I.best_asset(rows.limit(0)).first()[0] == "XLE"


def test_volatility(spark):
    rows = history("A", 500, 9) + history("B", 9, 3)
    got = {r.symbol: r.volatility for r in I.volatility(frame(spark, rows)).collect()}
    close = pd.Series([r[2] for r in rows[:500]])
    returns = (close / close.shift(1)).apply(lambda x: math.log(x)).dropna()
    assert got == {"A": pytest.approx(round(returns.std() * 252**0.5 * 100, 2), abs=0.011)}


def test_previous_close_crosses_slices(spark):
    rows = [("A", dt.datetime(2024, 1, 1), 1.0), ("A", dt.datetime(2024, 3, 1), 2.0), ("A", dt.datetime(2024, 3, 2), 4.0)]
    got = {r.rn: (r.n, r.prev_close) for r in B.numbered(frame(spark, rows), 86_400).collect()}
    assert got == {1: (3, None), 2: (3, 1.0), 3: (3, 2.0)}


def test_resample_takes_first_and_last_by_time_then_id(spark):
    t = dt.datetime(2024, 1, 1, 5, 0)
    rows = [("A", t, 2, 9.0), ("A", t, 1, 5.0), ("A", t.replace(minute=30), 3, 1.0), ("A", t.replace(minute=30), 4, 7.0)]
    bar = B.resample(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id bigint, value double")).first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (5.0, 9.0, 1.0, 7.0, 4)


def test_resample_with_a_tie_column_needs_no_sort(spark):
    t = dt.datetime(1969, 12, 31, 23, 5)
    rows = [("A", t, i, float(n)) for n, i in enumerate((3, -2, 2**63 - 1, -(2**63)))]
    bars = B.resample(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id bigint, value double"))
    bar = bars.first()
    assert (bar.open, bar.close) == (3.0, 2.0)
    assert "SortAggregate" not in bars._jdf.queryExecution().executedPlan().toString()


def test_row_order_and_partitions_do_not_matter(spark):
    df = frame(spark, history("A", 900, 6) + history("B", 700, 7))
    one = sorted(map(tuple, I.indicator_records(df).collect()), key=str)
    two = sorted(map(tuple, I.indicator_records(df.orderBy("close").repartition(13)).collect()), key=str)
    assert one == two


def test_indicator_windows_share_one_exchange_per_key(spark):
    plan = I.indicator_series(frame(spark, history("A", 50)))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    by_block = [line for line in exchanges if "_block" in line]
    assert len(by_block) <= 3  # the bars once; the sums per block before and after they are carried on
    assert not any("SinglePartition" in line for line in plan.splitlines())


def test_unique_times_need_no_tie_column(spark):
    rows = [("A", dt.datetime(2024, 1, 1, 5, m), m, float(m)) for m in (10, 0, 30)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id bigint, value double")
    plain = B.resample(ticks.drop("id"), tie=None)
    assert [tuple(r) for r in plain.collect()] == [tuple(r) for r in B.resample(ticks).collect()]
    assert "SortAggregate" not in plain._jdf.queryExecution().executedPlan().toString()


def test_best_asset_of_a_day_ignores_later_bars(spark):
    rows = history("A", 900, 6) + history("B", 700, 7)
    cut = dt.datetime(2024, 1, 20)
    whole = {r.d: r.best_asset for r in I.best_asset_by_day(I.records_by_day(frame(spark, rows))).collect()}
    early = I.best_asset_by_day(I.records_by_day(frame(spark, [r for r in rows if r[1] < cut])))
    for row in early.filter(f"d < DATE'{cut:%Y-%m-%d}'").collect():
        assert whole[row.d] == row.best_asset


def flat_after_moves(moving=300, flat=2000):
    rows = history("HALT", moving, 11)
    last = rows[-1]
    return rows + [("HALT", last[1] + dt.timedelta(hours=i + 1), last[2]) for i in range(flat)]


@pytest.mark.parametrize("block_rows", [1024, 256, 100])
def test_a_flat_price_keeps_its_rsi(spark, block_rows):
    rows = flat_after_moves()
    got = I.indicator_series(frame(spark, rows), block_rows).toPandas().sort_values("rn").reset_index(drop=True)
    want = expected([r[2] for r in rows])
    for column in want:
        assert (got[column] - want[column]).abs().max() < 1e-9, column
    latest = I.indicator_latest(frame(spark, rows), block_rows=block_rows).first()
    assert latest.rsi == pytest.approx(want.rsi.iloc[-1], abs=1e-9)
    record = I.indicator_records(frame(spark, rows)).first()
    assert not any("Band" in s for s in record.ta_signals)


def test_a_flat_price_keeps_its_rsi_longer_than_a_double_decays(spark):
    rows = flat_after_moves(flat=14_000)
    want = expected([r[2] for r in rows[:300]]).rsi.iloc[-1]
    assert I.indicator_latest(frame(spark, rows)).first().rsi == pytest.approx(want, abs=1e-9)
    moved = rows + [("HALT", rows[-1][1] + dt.timedelta(hours=1), rows[-1][2] + 1)]
    assert I.indicator_latest(frame(spark, moved)).first().rsi == 100.0


def test_look_back_windows(spark):
    rows = history("A", 400, 12, step=86_400) + history("B", 400, 13, step=86_400)
    newest = dt.date(2024, 1, 1) + dt.timedelta(days=399)
    late = [r for r in rows if r[1].date() >= newest - dt.timedelta(days=90)]
    df = frame(spark, rows)
    assert sorted(map(str, I.indicator_records(df, as_of=newest).collect())) == sorted(map(str, I.indicator_records(frame(spark, late)).collect()))
    last60 = frame(spark, [r for r in rows if r[1].date() >= newest - dt.timedelta(days=60)])
    windowed, whole = ({r.symbol: r.volatility for r in x.collect()} for x in (I.volatility(df, as_of=newest), I.volatility(df)))
    assert windowed == {r.symbol: r.volatility for r in I.volatility(last60).collect()} != whole
    early = I.indicator_records(df, as_of=dt.date(2024, 2, 20))
    assert sorted(map(str, early.collect())) == sorted(map(str, I.indicator_records(frame(spark, [r for r in rows if r[1] < dt.datetime(2024, 2, 21)])).collect()))


def test_missing_closes_do_not_spoil_volatility(spark):
    rows = history("A", 30, 9)
    gap = [r if i != 12 else (r[0], r[1], float("nan")) for i, r in enumerate(rows)]
    close = pd.Series([r[2] for r in gap])
    returns = (close / close.shift(1)).apply(lambda x: math.log(x) if x == x else x).dropna()
    got = I.volatility(frame(spark, gap)).first().volatility
    assert got == pytest.approx(round(returns.std() * 252**0.5 * 100, 2), abs=0.011)
