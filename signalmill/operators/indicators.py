"""RSI, MACD, Bollinger bands, scores and volatility for all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_ASSET, TRADING_DAYS
from ..functions.lookup import quoted
from ..functions.numeric import fixed_sql, half_even, rounded
from ..sources.series import carried
from ..functions.times import AsOf, days_before
from . import bars as B
from .bars import BLOCK_ROWS

MIN_BARS = 26
LOOKBACK_DAYS = 90
RSI_ROWS, BAND_ROWS, SIGNAL_START = 14, 20, 34
INDICATORS = ["rsi", "macd", "macd_signal", "macd_hist", "bb_high", "bb_mid", "bb_low"]
RECORD_DIGITS = {"close": 2, "rsi": 2, "macd": 4, "macd_signal": 4, "macd_hist": 4, "bb_high": 2, "bb_mid": 2, "bb_low": 2}
USABLE = "close IS NOT NULL AND NOT isnan(close)"


GAIN, FAST, SLOW, SIGNAL = 1 / 14, 2 / 13, 2 / 27, 0.2
# Rows after which the slowest of these averages has lost its start altogether: the weight is no double any more.
FORGOTTEN_ROWS = 10_100


def _local(value: str, alpha: float, seed: int, where: str = "true") -> str:
    """What the rows of a block add to an exponential average, as a weighted running sum.

    With q = 1 - alpha and k the row's place in its block: q^k * sum of w * x(j) * q^-j, where w is 1 at row ``seed`` of the
    history, alpha after it and 0 before. q^-k stays far inside a double for the lengths that blocks may have.
    """
    weight = f"CASE WHEN NOT ({where}) OR rn < {seed} THEN 0d WHEN rn = {seed} THEN 1d ELSE {alpha!r}d END"
    return f"pow({1 - alpha!r}d, _k) * sum({weight} * {value} * pow({1 - alpha!r}d, -_k)) OVER (PARTITION BY symbol, _block ORDER BY rn ROWS UNBOUNDED PRECEDING)"


def _block_sums(rows: DataFrame, block_rows: int) -> DataFrame:
    """What each block's rows add to every average by the block's end: one aggregate, no window.

    The signal averages the line, so a close enters it by the sum of both decays over the rows in between.
    """
    s = 1 - SIGNAL
    seed = "CASE WHEN rn = 1 THEN 1d ELSE {0!r}d END"
    sums = {
        "_gain": f"greatest(close - prev_close, 0d) * {GAIN!r}d * pow({1 - GAIN!r}d, _m)",
        "_loss": f"greatest(prev_close - close, 0d) * {GAIN!r}d * pow({1 - GAIN!r}d, _m)",
    }
    entering = []
    for name, alpha in (("_fast", FAST), ("_slow", SLOW)):
        q, weight = 1 - alpha, seed.format(alpha)
        sums[name] = f"close * {weight} * pow({q!r}d, _m)"
        after = f"{SIGNAL / (q - s)!r}d * (pow({q!r}d, _m + 1) - pow({s!r}d, _m + 1))"
        first = (
            f"pow({q!r}d, {MIN_BARS} - rn) * (pow({s!r}d, _end - {MIN_BARS})"
            f" + {SIGNAL * q / (q - s)!r}d * (pow({q!r}d, _end - {MIN_BARS}) - pow({s!r}d, _end - {MIN_BARS})))"
        )
        entering.append(f"{weight} * (CASE WHEN rn > {MIN_BARS} THEN {after} ELSE {first} END)")
    sums["_signal"] = f"close * ({entering[0]} - {entering[1]})"
    placed = rows.selectExpr("symbol", "close", "prev_close", "rn", f"(rn - 1) div {block_rows} AS _block", "n", f"least(n, ((rn - 1) div {block_rows} + 1) * {block_rows}) AS _end")
    placed = placed.selectExpr("*", "_end - rn AS _m")
    return placed.groupBy("symbol", "_block").agg(
        F.max("_end").alias("rn"), F.max("n").alias("n"), F.expr("max(CASE WHEN close > prev_close THEN rn END) AS _rise"),
        F.expr("max(CASE WHEN close < prev_close THEN rn END) AS _fall"),
        *[F.expr(f"coalesce(sum({value}), 0d) AS {name}") for name, value in sums.items()],
    ).withColumn("_k", F.expr(f"rn - _block * {block_rows}"))


def _decayed(columns: dict[str, float], blocks: int) -> list[str]:
    """The averages at the end of a block: what it and the blocks before it add, each decayed by the rows in between."""
    frame = f"(PARTITION BY symbol ORDER BY _block ROWS {blocks} PRECEDING)"
    rows = f"collect_list(struct(rn, {', '.join(columns)})) OVER {frame}"
    return [f"aggregate({rows}, 0d, (t, b) -> t + b.{name} * pow({1 - alpha!r}d, rn - b.rn)) AS _y{name}" for name, alpha in columns.items()]


def _added_by_start(alpha: float) -> str:
    """The signal's share, _k rows into a block, of an average that enters the block with value one."""
    q, s = 1 - alpha, 1 - SIGNAL
    return f"({SIGNAL * q / (q - s)!r}d * (pow({q!r}d, _k) - pow({s!r}d, _k)))"


def _block_states(rows: DataFrame, block_rows: int) -> DataFrame:
    """Every average at the end of each block: _y_fast, _y_slow, _y_signal, and _moved (rn, gain, loss, and where the last
    rise and fall were) at the end of the last block with a move."""
    back = -(-FORGOTTEN_ROWS // block_rows)
    ends = _block_sums(rows, block_rows)
    ends = ends.selectExpr("*", *_decayed({"_gain": GAIN, "_loss": GAIN, "_fast": FAST, "_slow": SLOW}, back))
    order = "OVER (PARTITION BY symbol ORDER BY _block)"
    moves = f"max(_rise) {order} AS rise, max(_fall) {order} AS fall"
    ends = ends.selectExpr("*", f"struct(rn, _y_gain AS gain, _y_loss AS loss, {moves}) AS _here")
    ends = ends.selectExpr(
        "symbol", "_block", "rn", "n", "_y_fast", "_y_slow",
        f"last(CASE WHEN _gain + _loss > 0 THEN _here END, true) {order} AS _moved",
        f"_signal + coalesce(lag(_y_fast) {order} * {_added_by_start(FAST)} - lag(_y_slow) {order} * {_added_by_start(SLOW)}, 0d) AS _signal",
    )
    return ends.selectExpr("*", *_decayed({"_signal": SIGNAL}, back))


def _known(rows: str) -> list[str]:
    """The indicators from _gain, _loss, _line, _signal, _mid and _dev, NULL before ``rows`` bars suffice."""
    known = {
        "rsi": (RSI_ROWS, "CASE WHEN _loss = 0 THEN 100d ELSE 100 - 100 / (1 + _gain / _loss) END"),
        "macd": (MIN_BARS, "_line"),
        "macd_signal": (SIGNAL_START, "_signal"),
        "macd_hist": (SIGNAL_START, "_line - _signal"),
        "bb_high": (BAND_ROWS, "_mid + 2 * _dev"),
        "bb_mid": (BAND_ROWS, "_mid"),
        "bb_low": (BAND_ROWS, "_mid - 2 * _dev"),
    }
    return [f"CASE WHEN {rows} >= {first} THEN {value} END AS {name}" for name, (first, value) in known.items()]


def _row_states(bars: DataFrame, block_rows: int, slice_seconds: int) -> DataFrame:
    """What all indicators need, on every bar: _mid and _dev of the band, the averages _fast, _slow, _signal, and the state of
    gains and losses (_gain, _loss) as of row _ref, where _rise and _fall are the last rows that rose and fell.

    Inside a block, averages are running sums of what its own rows add. The state with which a block begins is the
    decayed sum of what the blocks before it added, one row per block, exact in double arithmetic. Gain and loss enter
    the RSI as a ratio, which a flat price does not change however long it lasts, so their state is that of the last
    block with a move.
    """
    if not 2 * SIGNAL_START <= block_rows <= 2048:
        raise ValueError("a block has 68 to 2048 rows")
    numbered = B.numbered(bars.select("symbol", "ts", "close").filter(USABLE), slice_seconds)
    rows = B.blocked(numbered, block_rows, BAND_ROWS - 1)
    band = f"OVER (PARTITION BY symbol, _block ORDER BY rn ROWS {BAND_ROWS - 1} PRECEDING)"
    flat = f"max(close) {band} = min(close) {band}"
    rows = rows.selectExpr(
        "symbol", "ts", "close", "rn", "n", "_block", "_own", f"(rn - 1) % {block_rows} + 1 AS _k",
        "CASE WHEN rn > 1 THEN greatest(close - prev_close, 0d) ELSE 0d END AS _up",
        "CASE WHEN rn > 1 THEN greatest(prev_close - close, 0d) ELSE 0d END AS _down",
        f"CASE WHEN {flat} THEN close ELSE avg(close) {band} END AS _mid",
        f"CASE WHEN {flat} THEN 0d ELSE stddev_pop(close) {band} END AS _dev",
    ).filter("_own")
    so_far = "OVER (PARTITION BY symbol, _block ORDER BY rn ROWS UNBOUNDED PRECEDING)"
    rows = rows.selectExpr(
        "*", f"{_local('_up', GAIN, 1)} AS _gain", f"{_local('_down', GAIN, 1)} AS _loss",
        f"{_local('close', FAST, 1)} AS _fast", f"{_local('close', SLOW, 1)} AS _slow",
        f"max(CASE WHEN _up > 0 THEN rn END) {so_far} AS _rise", f"max(CASE WHEN _down > 0 THEN rn END) {so_far} AS _fall",
    )
    rows = rows.selectExpr("*", f"{_local('(_fast - _slow)', SIGNAL, MIN_BARS)} AS _signal")
    ends = _block_states(numbered, block_rows)
    state = ends.selectExpr("symbol", "_block + 1 AS _block", "_y_fast", "_y_slow", "_moved", "_y_signal")
    rows = rows.join(state, ["symbol", "_block"], "left")
    since = f"pow({1 - GAIN!r}d, rn - _moved.rn)"
    still = "_gain = 0 AND _loss = 0 AND _moved IS NOT NULL"
    return rows.selectExpr(
        "symbol", "ts", "close", "rn", "n", "_mid", "_dev",
        f"CASE WHEN {still} THEN _moved.gain ELSE _gain + coalesce(_moved.gain * {since}, 0d) END AS _gain",
        f"CASE WHEN {still} THEN _moved.loss ELSE _loss + coalesce(_moved.loss * {since}, 0d) END AS _loss",
        f"CASE WHEN {still} THEN _moved.rn ELSE rn END AS _ref", "coalesce(_rise, _moved.rise, 0) AS _rise", "coalesce(_fall, _moved.fall, 0) AS _fall",
        f"_fast + coalesce(_y_fast * pow({1 - FAST!r}d, _k), 0d) AS _fast", f"_slow + coalesce(_y_slow * pow({1 - SLOW!r}d, _k), 0d) AS _slow",
        f"_signal + coalesce(_y_signal * pow({1 - SIGNAL!r}d, _k) + _y_fast * {_added_by_start(FAST)} - _y_slow * {_added_by_start(SLOW)}, 0d) AS _signal",
    )


def indicator_series(bars: DataFrame, block_rows: int = BLOCK_ROWS, slice_seconds: int = B.SLICE_SECONDS) -> DataFrame:
    """Every indicator on every bar: symbol, ts, close, rn, n and INDICATORS (NULL while warming up)."""
    rows = _row_states(bars, block_rows, slice_seconds).withColumn("_line", F.expr("_fast - _slow"))
    return rows.selectExpr("symbol", "ts", "close", "rn", "n", *_known("rn"))


def indicators_by_day(
    bars: DataFrame, days: int = LOOKBACK_DAYS, block_rows: int = BLOCK_ROWS, slice_seconds: int = B.SLICE_SECONDS,
) -> DataFrame:
    """Indicators of each symbol at the end of every date d, over that date's own look-back: symbol, d, ts, close, n, INDICATORS.

    Equal to ``indicator_latest(bars, d, days)`` of every d on which a symbol has a bar in its look-back. An average that
    starts anew at row a of the history is, at row b, the average of the whole history plus what its start replaces:
    q^(b - a) * (x(a) - average(a)). So one pass over the history and two states a date give the averages of all look-backs:
    that of the date's last bar, carried to the next bar, and that of the look-back's first bar. The signal starts at the
    look-back's 26th bar and has that row's state, too. Gains and losses start at nothing; they are exactly nothing when
    the last rise or fall was before the look-back.
    """
    rows = _row_states(bars, block_rows, slice_seconds).withColumn("d", F.to_date("ts"))
    state = "rn, close, _gain, _loss, _ref, _rise, _fall, _fast, _slow, _signal"
    daily = rows.groupBy("symbol", "d").agg(
        F.expr(f"max_by(struct(ts, _mid, _dev, {state}), rn) AS _b"), F.expr("min_by(struct(rn, close, _gain, _loss, _ref, _fast, _slow), rn) AS _a")
    )
    last = carried(daily.select("symbol", "d", "_b"), "symbol", days)
    # a date's first bar starts the look-backs of the dates that the bars before it no longer reach
    starts = daily.selectExpr("symbol", "d", "_a", "lag(d) OVER (PARTITION BY symbol ORDER BY d) AS _before")
    reach = f"sequence(greatest(d, coalesce(date_add(_before, {days + 1}), d)), date_add(d, {days}))"
    starts = starts.selectExpr("symbol", "_a", f"_a.rn + {MIN_BARS - 1} AS rn", f"explode({reach}) AS d")
    seeds = rows.select("symbol", "rn", F.col("_fast").alias("_r_fast"), F.col("_slow").alias("_r_slow"), F.col("_signal").alias("_r_signal"))
    both = last.join(starts.join(seeds, ["symbol", "rn"], "left").drop("rn"), ["symbol", "d"])
    fast, slow, gain, s = repr(1 - FAST), repr(1 - SLOW), repr(1 - GAIN), repr(1 - SIGNAL)
    both = both.selectExpr(
        "symbol", "d", "_b", "_a", "_b.rn - _a.rn AS _m", "_a.close - _a._fast AS _cf", "_a.close - _a._slow AS _cs",
        "_r_fast", "_r_slow", "_r_signal", f"pow({s}d, _b.rn - _a.rn - {MIN_BARS - 1}) AS _since",
    )

    def moved(name: str, last_move: str) -> str:
        return f"CASE WHEN _b.{last_move} <= _a.rn THEN 0d ELSE greatest(_b.{name} - pow({gain}d, _b._ref - _a._ref) * _a.{name}, 0d) END AS {name}"

    def entered(q: str) -> str:
        """What an average of value one at the start has added to the signal since the signal's own start."""
        return f"({SIGNAL / (float(q) - float(s))!r}d * pow({q}d, {MIN_BARS}) * (pow({q}d, _m - {MIN_BARS - 1}) - _since))"

    at_seed = f"(_r_fast + _cf * pow({fast}d, {MIN_BARS - 1}) - _r_slow - _cs * pow({slow}d, {MIN_BARS - 1}))"
    both = both.selectExpr(
        "symbol", "d", "_b.ts AS ts", "_b.close AS close", "_m + 1 AS n", "_b._mid AS _mid", "_b._dev AS _dev",
        moved("_gain", "_rise"), moved("_loss", "_fall"),
        f"_b._fast + _cf * pow({fast}d, _m) - _b._slow - _cs * pow({slow}d, _m) AS _line",
        f"CASE WHEN _m >= {MIN_BARS - 1} THEN _since * {at_seed} + (_b._signal - _since * _r_signal) + _cf * {entered(fast)} - _cs * {entered(slow)} END AS _signal",
    )
    return both.selectExpr("symbol", "d", "ts", "close", "n", *_known("n"))


def records_by_day(bars: DataFrame, symbols=None, days: int = LOOKBACK_DAYS) -> DataFrame:
    """``indicator_records(bars, symbols, d, days)`` of every date d: one row per symbol and date."""
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(list(symbols)))
    return scored(indicators_by_day(bars, days)).select("symbol", "d", *rounded(RECORD_DIGITS), "ta_score", "ta_signals")


def within(bars: DataFrame, as_of: AsOf | None, days: int) -> DataFrame:
    """The bars of the ``days`` days up to and with ``as_of``; all bars without one."""
    if as_of is None:
        return bars
    return bars.filter((F.col("ts") >= days_before(as_of, days)) & (F.col("ts") < days_before(as_of, -1)))


def indicator_latest(bars: DataFrame, as_of: AsOf | None = None, days: int = LOOKBACK_DAYS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Indicators of each symbol's last bar, over the look-back before ``as_of`` or all given bars; n counts those bars.

    The state at the end of the last block is all that the averages need, and the bands the last bars: no row window.
    """
    rows = B.numbered(within(bars, as_of, days).select("symbol", "ts", "close").filter(USABLE))
    ends = _block_states(rows, block_rows).filter("rn = n").selectExpr(
        "symbol", "n", "coalesce(_moved.gain, 0d) AS _gain", "coalesce(_moved.loss, 0d) AS _loss", "_y_fast - _y_slow AS _line", "_y_signal AS _signal"
    )
    last = rows.filter(f"rn > n - {BAND_ROWS}").groupBy("symbol").agg(
        F.max_by("ts", "rn").alias("ts"), F.expr("transform(sort_array(collect_list(struct(rn, close))), x -> x.close) AS _closes")
    )
    total = "aggregate(_closes, 0d, (t, x) -> t + x)"
    last = last.selectExpr("symbol", "ts", "_closes", "element_at(_closes, -1) AS close", "array_max(_closes) = array_min(_closes) AS _flat", f"{total} / size(_closes) AS _mean")
    squares = "aggregate(_closes, 0d, (t, x) -> t + (x - _mean) * (x - _mean)) / size(_closes)"
    last = last.selectExpr("symbol", "ts", "close", "CASE WHEN _flat THEN close ELSE _mean END AS _mid", f"CASE WHEN _flat THEN 0d ELSE sqrt({squares}) END AS _dev")
    return last.join(ends, "symbol").selectExpr("symbol", "ts", "close", "n", *_known("n"))


def history_gate(bars: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """Usable bars per symbol and whether they suffice."""
    usable = F.expr(f"count_if({USABLE}) AS n_close")
    return bars.groupBy("symbol").agg(usable).selectExpr(
        "symbol", "n_close", f"CASE WHEN n_close < {min_bars} THEN 'insufficient data' ELSE 'ok' END AS status"
    )


def scored(latest: DataFrame) -> DataFrame:
    """Adds ta_score and the ordered list of reasons ta_signals; symbols with too few bars drop out."""
    bullish, bearish = "macd_hist > 0 AND macd > macd_signal", "macd_hist < 0"
    score = (
        "CASE WHEN rsi < 30 THEN 2 WHEN rsi > 70 THEN -2 ELSE 0 END"
        f" + CASE WHEN {bullish} THEN 1 WHEN {bearish} THEN -1 ELSE 0 END"
        " + CASE WHEN close < bb_low THEN 1 WHEN close > bb_high THEN -1 ELSE 0 END"
    )
    mood = "CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' ELSE 'neutral' END"
    reasons = (
        f"array_compact(array(concat('RSI ', {mood}, ' (', {fixed_sql('rsi', 1)}, ')'),"
        f" CASE WHEN {bullish} THEN 'MACD bullish crossover' WHEN {bearish} THEN 'MACD bearish' END,"
        " CASE WHEN close < bb_low THEN 'Price below lower Bollinger Band (oversold)'"
        " WHEN close > bb_high THEN 'Price above upper Bollinger Band (overbought)' END))"
    )
    return latest.filter(f"n >= {MIN_BARS}").selectExpr("*", f"{score} AS ta_score", f"{reasons} AS ta_signals")


def indicator_records(bars: DataFrame, symbols=None, as_of: AsOf | None = None, days: int = LOOKBACK_DAYS) -> DataFrame:
    """The rounded record per symbol, from the look-back before ``as_of`` or all given bars."""
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(list(symbols)))
    return scored(indicator_latest(bars, as_of, days)).select("symbol", *rounded(RECORD_DIGITS), "ta_score", "ta_signals")


def direction_by_score(records: DataFrame) -> DataFrame:
    """One row: total score and the direction it stands for."""
    return records.selectExpr("coalesce(sum(ta_score), 0) AS total_score").selectExpr(
        "total_score",
        "CASE WHEN total_score > 1 THEN 'BULLISH' WHEN total_score < -1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction",
    )


def _best(order) -> Column:
    place = "0"
    if order:
        place = f"coalesce(nullif(array_position(array({quoted(order)}), symbol), 0), {len(order) + 1})"
    return F.expr(f"coalesce(min_by(symbol, struct(-abs(ta_score), {place}, symbol)), '{DEFAULT_ASSET}') AS best_asset")


def best_asset(records: DataFrame, order=None) -> DataFrame:
    """One row: the symbol of largest absolute score; ties go by the given order, then by name."""
    return records.agg(_best(order))


def best_asset_by_day(records: DataFrame, order=None) -> DataFrame:
    """The best asset of every date, over ``records_by_day`` rows: no bar after a date has a say, none before its look-back."""
    return records.groupBy("d").agg(_best(order))


VOLATILITY_DAYS = 60


def log_returns(bars: DataFrame, slice_seconds: int = B.SLICE_SECONDS) -> DataFrame:
    """ln(close / previous close) per bar; the first bar of a symbol has none, nor has one beside a missing close."""
    rows = B.numbered(bars.select("symbol", "ts", "close"), slice_seconds)
    value = "CASE WHEN close > 0 AND prev_close > 0 THEN ln(close / prev_close) END AS log_return"
    return rows.selectExpr("symbol", "ts", "n", value).filter("log_return IS NOT NULL AND NOT isnan(log_return)")


def volatility(bars: DataFrame, symbols=None, min_bars: int = 10, as_of: AsOf | None = None, days: int = VOLATILITY_DAYS) -> DataFrame:
    """Annualised volatility in percent over the look-back before ``as_of`` or all given bars; symbols with too few bars
    or returns are absent."""
    bars = within(bars, as_of, days)
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(list(symbols)))
    annual = F.expr(f"stddev_samp(log_return) * sqrt({TRADING_DAYS}d) * 100 AS _annual")
    per_symbol = log_returns(bars).groupBy("symbol").agg(annual, F.max("n").alias("_n"))
    usable = per_symbol.filter(f"_n >= {min_bars} AND _annual IS NOT NULL AND NOT isnan(_annual)")
    return usable.select("symbol", half_even("_annual", 2).alias("volatility"))


def volatility_by_day(
    bars: DataFrame, symbols=None, min_bars: int = 10, days: int = VOLATILITY_DAYS, slice_seconds: int = B.SLICE_SECONDS,
) -> DataFrame:
    """``volatility(bars, symbols, min_bars, d, days)`` of every date d: symbol, d, volatility.

    Each date's returns become one row of count, mean and sum of squares about the mean, the return of its first bar apart:
    it does not count when the date opens the look-back. The dates of a look-back (at most ``days`` + 1 rows) are merged
    pairwise, so nothing is ever subtracted and no digits are lost, and only date rows are ordered per symbol.
    """
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(list(symbols)))
    rows = B.numbered(bars.select("symbol", "ts", "close"), slice_seconds)
    value = "CASE WHEN close > 0 AND prev_close > 0 AND NOT isnan(close / prev_close) THEN ln(close / prev_close) END AS _r"
    rows = rows.selectExpr("symbol", "to_date(ts) AS d", "rn", value)
    opening = rows.groupBy("symbol", "d").agg(F.min("rn").alias("_first"), F.min_by(F.struct("_r"), "rn").alias("_opening"), F.count("*").alias("_bars"))
    first = opening.selectExpr("symbol", "_first AS rn", "true AS _opens")
    others = rows.join(first, ["symbol", "rn"], "left").filter("_opens IS NULL AND _r IS NOT NULL").groupBy("symbol", "d").agg(
        F.expr("CAST(count(_r) AS double) AS k"), F.avg("_r").alias("mean"), F.expr("var_pop(_r) * count(_r) AS m2")
    )
    known = "coalesce(k, 0d) AS k, coalesce(mean, 0d) AS mean, coalesce(m2, 0d) AS m2"
    daily = opening.join(others, ["symbol", "d"], "left").selectExpr(
        "symbol", "d", f"struct(d, _bars AS bars, _opening._r AS opening, {known}) AS _day"
    )
    dense = carried(daily, "symbol", days).withColumn("_own", F.expr("CASE WHEN _day.d = d THEN _day END"))
    frame = f"OVER (PARTITION BY symbol ORDER BY d RANGE BETWEEN {days} PRECEDING AND CURRENT ROW)"
    dense = dense.selectExpr("symbol", "d", f"collect_list(_own) {frame} AS _days")
    part = "named_struct('k', x.k, 'mean', x.mean, 'm2', x.m2)"
    alone = "named_struct('k', 1d, 'mean', x.opening, 'm2', 0d)"
    parts = f"filter(flatten(transform(_days, (x, i) -> CASE WHEN i = 0 OR x.opening IS NULL THEN array({part}) ELSE array({alone}, {part}) END)), p -> p.k > 0)"
    merged = (
        "aggregate(_parts, named_struct('k', 0d, 'mean', 0d, 'm2', 0d), (t, p) -> named_struct('k', t.k + p.k,"
        " 'mean', t.mean + (p.mean - t.mean) * p.k / (t.k + p.k),"
        " 'm2', t.m2 + p.m2 + (p.mean - t.mean) * (p.mean - t.mean) * t.k * p.k / (t.k + p.k)))"
    )
    dense = dense.selectExpr("symbol", "d", f"{parts} AS _parts", "aggregate(_days, 0L, (t, x) -> t + x.bars) AS _n")
    dense = dense.selectExpr("symbol", "d", "_n", f"{merged} AS _all").filter(f"_n >= {min_bars}")
    annual = dense.withColumn("_annual", F.expr(f"sqrt(_all.m2 / nullif(_all.k - 1, 0)) * sqrt({TRADING_DAYS}d) * 100")).filter("_annual IS NOT NULL AND NOT isnan(_annual)")
    return annual.select("symbol", "d", half_even("_annual", 2).alias("volatility"))
