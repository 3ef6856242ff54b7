"""Windows over daily bars: moving averages, trend gate, relative strength, weekly platform, wave score, forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.bars import week_of, weekly

#: Points of the wave score by component; thresholds of its signals; bars it looks at.
POINTS = {"RSI_TURN": 20, "MACD_CONTRACTION": 15, "NO_NEW_LOW": 15, "BOTTOM_STRUCTURE": 15, "MA_RECOVERY": 15, "SHORT_PRESSURE_MA5": 10, "VOLUME_CONFIRM": 10}
STRONG, CANDIDATE, LOOK_BACK, LEAST_BARS = 85, 70, 120, 60


def _by_symbol():
    return Window.partitionBy("symbol").orderBy("trading_date")


def _mean(column: str, n: int, skip: int = 0) -> Column:
    """Mean of the last n rows that end `skip` rows ago; 0 if there are fewer."""
    w = _by_symbol().rowsBetween(-(n - 1) - skip, -skip)
    return F.when(F.count(column).over(w) >= n, F.avg(column).over(w)).otherwise(0.0)


def percent(value: Column, base: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise((value - base) / base * 100)


def moving_averages(daily: DataFrame) -> DataFrame:
    out = daily.withColumns({f"ma{n}": _mean("close_ticks", n) for n in (5, 10, 20, 30, 60)} | {"ma20_before": _mean("close_ticks", 20, 1)})
    return out.withColumns({"ma20_slope": percent(F.col("ma20"), F.col("ma20_before")), "trend_strength": percent(F.col("ma20"), F.col("ma60"))})


def trend_gate(daily: DataFrame) -> DataFrame:
    """20-day return, drawdown from the 60-day high, falling averages; the gate opens with two of three."""
    w = _by_symbol()
    rows = daily.withColumns({"ma10": _mean("close_ticks", 10), "ma20": _mean("close_ticks", 20)})
    rows = rows.withColumns(
        {
            "return_20": F.col("close_ticks") / F.lag("close_ticks", 20).over(w) - 1,
            "drawdown_60": F.col("close_ticks") / F.max("high_ticks").over(w.rowsBetween(-59, 0)) - 1,
            "falling": (F.col("ma10") < F.col("ma20")) & (F.col("ma20") < F.lag("ma20", 5).over(w)),
        }
    )
    hits = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("return_20") <= -0.08, F.col("drawdown_60") <= -0.15, F.col("falling"))), F.lit(0))
    return rows.withColumn("gate", hits >= 2)


def pullback_volume(daily: DataFrame) -> DataFrame:
    """Mean volume of the last 5 days over that of the 10 before; 0 with fewer than 15 days."""
    w = _by_symbol()
    old = F.avg("volume").over(w.rowsBetween(-14, -5))
    full = F.count("*").over(w.rowsBetween(-14, 0)) >= 15
    return daily.withColumn("pullback_volume_ratio", F.when(full & (old > 0), F.avg("volume").over(w.rowsBetween(-4, 0)) / old).otherwise(0.0))


def relative_strength(daily: DataFrame) -> DataFrame:
    """Five-day return, support (the lower positive of MA20, MA30) and change against the market's mean of the day."""
    w = _by_symbol()
    rows = moving_averages(daily).withColumns({"pre_close": F.lag("close_ticks").over(w), "four_ago": F.lag("close_ticks", 4).over(w)})
    rows = rows.withColumn("change", percent(F.col("close_ticks"), F.coalesce("pre_close", F.lit(0))))
    five = F.when(F.col("four_ago").isNotNull(), percent(F.col("close_ticks"), F.col("four_ago"))).otherwise(0.0)
    rows = rows.withColumns({"five_day_return": five, "support": support()})
    return rows.join(market_change(daily), "trading_date", "left").withColumn("relative_strength", F.col("change") - F.coalesce("market_change", F.lit(0.0)))


def support() -> Column:
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.coalesce(F.least(positive("ma20"), positive("ma30")), F.lit(0.0))


def with_prev_close(quotes: DataFrame, daily: DataFrame, price: str = "price_ticks") -> DataFrame:
    """quotes (symbol, trading_date, a price, pre_close or null) with prev_close (their own, else the close of the newest daily bar
    before their date) and change_percent."""
    days = as_of_dates(quotes.select("symbol", F.col("trading_date").alias("as_of")).distinct(), daily, inclusive=False)
    close = days.join(daily.select("symbol", F.col("trading_date").alias("bar_date"), F.col("close_ticks").alias("last_close")), ["symbol", "bar_date"]).drop("bar_date")
    rows = quotes.join(close.withColumnRenamed("as_of", "trading_date"), ["symbol", "trading_date"], "left")
    rows = rows.withColumn("prev_close", F.coalesce("pre_close", "last_close")).drop("last_close")
    return rows.withColumn("change_percent", F.when(F.col("prev_close") > 0, percent(F.col(price), F.col("prev_close"))))


def market_change(daily: DataFrame) -> DataFrame:
    """Mean change of the day over symbols that have a close before it; how many they are."""
    before = F.lag("close_ticks").over(_by_symbol())
    rows = daily.withColumn("pre_close", before).filter("pre_close > 0")
    return rows.groupBy("trading_date").agg(F.avg(percent(F.col("close_ticks"), F.col("pre_close"))).alias("market_change"), F.count("*").alias("symbols"))


def weekly_platform(weeks: DataFrame) -> DataFrame:
    """Of each completed week: 24-week high and low, ranges of 24 and 12 weeks, weeks whose high came within 3 % of the high; zeros with fewer than 12."""
    w = Window.partitionBy("symbol").orderBy("week")
    last24, last12 = w.rowsBetween(-23, 0), w.rowsBetween(-11, 0)
    enough = F.count("*").over(last12) >= 12
    high, low = F.max("high_ticks").over(last24), F.min("low_ticks").over(last24)
    highs = F.collect_list("high_ticks").over(last24)
    out = {
        "platform_high": high, "platform_low": low, "range_24": percent(high, low), "range_12": percent(F.max("high_ticks").over(last12), F.min("low_ticks").over(last12)),
        "touches": F.size(F.filter(highs, lambda h: h >= F.array_max(highs) * 0.97)),
    }
    return weeks.withColumns({k: F.when(enough, v).otherwise(0) for k, v in out.items()})


def forward_outcomes(signals: DataFrame, daily: DataFrame, days: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Returns of the close 1, 3, 5 bars after the signal day's bar and of the first bar at least seven days later (w1), best and worst
    of the next five bars; null where there is no bar."""
    w = _by_symbol()
    close = F.col("close_ticks")
    week = Window.partitionBy("symbol").orderBy(F.unix_date("trading_date")).rangeBetween(7, Window.unboundedFollowing)
    ahead = daily.withColumns(
        {f"d{n}": percent(F.lead("close_ticks", n).over(w), close) for n in days}
        | {"w1": percent(F.first("close_ticks").over(week), close), "mfe5": percent(F.max("high_ticks").over(w.rowsBetween(1, 5)), close), "mae5": percent(F.min("low_ticks").over(w.rowsBetween(1, 5)), close)}
    )
    return signals.join(ahead.select("symbol", "trading_date", *[f"d{n}" for n in days], "w1", "mfe5", "mae5"), ["symbol", "trading_date"], "left")


def as_of_dates(jobs: DataFrame, daily: DataFrame, inclusive: bool = True, date: str = "trading_date") -> DataFrame:
    """jobs (symbol, as_of) with bar_date, the newest date of the symbol's daily rows up to as_of, or before it; jobs without one go.
    One sort of both together, no join by range."""
    rows = daily.select("symbol", F.col(date).alias("d"), F.lit(0).alias("job"))
    both = rows.unionByName(jobs.select("symbol", F.col("as_of").alias("d"), F.lit(1 if inclusive else -1).alias("job")))
    w = Window.partitionBy("symbol").orderBy("d", "job").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.last(F.when(F.col("job") == 0, F.col("d")), ignorenulls=True).over(w)
    return both.withColumn("bar_date", newest).filter("job <> 0 and bar_date is not null").select("symbol", F.col("d").alias("as_of"), "bar_date").distinct()


def look_back(jobs: DataFrame, daily: DataFrame, n: int = LOOK_BACK, inclusive: bool = True) -> DataFrame:
    """Per job (symbol, as_of) the last n daily bars up to as_of (or before it), as an array in time order."""
    bar = F.struct("trading_date", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume")
    ends = as_of_dates(jobs, daily, inclusive)
    windows = daily.select("symbol", F.col("trading_date").alias("bar_date"), F.collect_list(bar).over(_by_symbol().rowsBetween(-(n - 1), 0)).alias("bars"))
    return windows.join(ends, ["symbol", "bar_date"]).select("symbol", "as_of", "bars")


def latest_30m(bars30: DataFrame) -> DataFrame:
    """Of each symbol's day the last 30-minute bar: volume over the mean of the five bars before it (of any day), place of the close,
    upper wick, and whether it closed above its open."""
    w = Window.partitionBy("symbol").orderBy("eob")
    o, h, low, c = (F.col(f"{x}_ticks") for x in ("open", "high", "low", "close"))
    mean = F.avg("volume").over(w.rowsBetween(-5, -1))
    wide = h > low
    rows = bars30.select(
        "symbol", "trading_date", "eob", F.when(mean > 0, F.col("volume") / mean).otherwise(0.0).alias("m30_volume_ratio"), F.when(wide, (c - low) / (h - low)).otherwise(1.0).alias("m30_close_position"),
        F.when(wide, (h - F.greatest(o, c)) / (h - low)).otherwise(0.0).alias("m30_upper_wick"), (c > o).alias("m30_bullish"),
    )
    names = ["eob", "m30_volume_ratio", "m30_close_position", "m30_upper_wick", "m30_bullish"]
    return rows.groupBy("symbol", "trading_date").agg(F.max_by(F.struct(*names), "eob").alias("m")).select("symbol", "trading_date", F.col("m.eob").alias("m30_eob"), *[f"m.{n}" for n in names[1:]])


def decline_wave(rows: DataFrame, bars: str = "bars", price: str = "price") -> DataFrame:
    """rows with their last 140 daily bars and a price: fall from the major high to the low after it, rebound from that low, repair from
    the low after the rebound, whether that is a second bottom, and whether the price is above MA10 and MA20.

    Zeros under 120 bars, or if the high is among the last 20. If the low is among the last five only the fall is known, and
    it is negative there."""
    get = lambda name: F.transform(bars, lambda b: b[name])
    out = rows.withColumns({"_h": get("high_ticks"), "_l": get("low_ticks"), "_c": get("close_ticks"), "_n": F.size(bars)})
    after = lambda a, i: F.slice(a, i + 2, F.greatest(F.col("_n") - i - 1, F.lit(0)))
    first = lambda a, v: F.array_position(a, v).cast("int")
    mean = lambda n: F.aggregate(F.slice("_c", F.greatest(F.col("_n") - n, F.lit(0)) + 1, n), F.lit(0.0), lambda s, x: s + x) / n
    out = out.withColumn("_i", first(F.col("_h"), F.array_max("_h")) - 1)
    out = out.withColumn("_low", F.array_min(after(F.col("_l"), F.col("_i")))).withColumn("_j", F.col("_i") + first(after(F.col("_l"), F.col("_i")), F.col("_low")))
    out = out.withColumn("_rise", F.array_max(after(F.col("_h"), F.col("_j")))).withColumn("_k", F.col("_j") + first(after(F.col("_h"), F.col("_j")), F.col("_rise")))
    out = out.withColumn("_rest", after(F.col("_l"), F.least(F.col("_k"), F.col("_n") - 2))).withColumn("_second", F.array_min("_rest"))
    known = F.coalesce((F.col("_n") >= 120) & (F.col("_i") < F.col("_n") - 20), F.lit(False))
    whole = known & F.coalesce(F.col("_j") < F.col("_n") - 5, F.lit(False))
    high = F.array_max("_h")
    second = (F.size("_rest") >= 2) & (F.col("_second") >= F.col("_low") * 0.98) & (F.col("_second") <= F.col("_rise") * 0.97)
    return out.withColumns(
        {
            "decline": F.when(whole, (high - F.col("_low")) / high * 100).when(known, percent(F.col("_low"), high)).otherwise(0.0),
            "rebound": F.when(whole, percent(F.col("_rise"), F.col("_low"))).otherwise(0.0), "repair": F.when(whole, percent(F.col(price), F.col("_second"))).otherwise(0.0),
            "second_bottom": whole & second, "breaks_trend": whole & (F.col(price) > F.greatest(mean(10), mean(20))),
        }
    ).drop("_h", "_l", "_c", "_n", "_i", "_low", "_j", "_rise", "_k", "_rest", "_second")


def daily_state(jobs: DataFrame, daily: DataFrame) -> DataFrame:
    """Per job (symbol, as_of) what its daily bars before as_of say: averages, slope, trend, last close, mean volume of five days, pull-back
    volume, the completed weeks' platform, and the last 140 bars."""
    w = _by_symbol()
    rows = pullback_volume(moving_averages(daily)).withColumns({"support": support(), "four_ago": F.lag("close_ticks", 4).over(w), "mean_volume": F.avg("volume").over(w.rowsBetween(-4, 0))})
    rows = rows.withColumn("ma20_slope", F.when(F.row_number().over(w) >= 21, F.col("ma20_slope")).otherwise(0.0))
    names = [*[f"ma{n}" for n in (5, 10, 20, 30, 60)], "ma20_slope", "trend_strength", "pullback_volume_ratio", "support", "four_ago", "mean_volume"]
    rows = rows.select("symbol", F.col("trading_date").alias("bar_date"), F.col("close_ticks").alias("last_close"), *names)
    state = as_of_dates(jobs, daily, inclusive=False).join(rows, ["symbol", "bar_date"])
    weeks = weekly_platform(weekly(daily))
    asked = state.select("symbol", week_of(F.col("as_of")).alias("as_of")).distinct()
    place = as_of_dates(asked, weeks, inclusive=False, date="week").select("symbol", F.col("as_of").alias("this_week"), F.col("bar_date").alias("week"))
    platform = place.join(weeks.select("symbol", "week", "platform_high", "platform_low", "range_24", "range_12", "touches"), ["symbol", "week"]).drop("week")
    state = state.withColumn("this_week", week_of(F.col("as_of"))).join(platform, ["symbol", "this_week"], "left").drop("this_week")
    return state.join(look_back(jobs, daily, 140, inclusive=False), ["symbol", "as_of"])


def rsi(closes: Column, n: int = 14) -> Column:
    """Wilder's RSI after each close from the n-th change on, seeded by the mean of the first n changes; 100 without losses."""
    changes = F.transform(F.sequence(F.lit(1), F.size(closes) - 1), lambda i: F.get(closes, i) - F.get(closes, i - 1))
    up, down = F.transform(changes, lambda x: F.greatest(x, F.lit(0.0))), F.transform(changes, lambda x: F.greatest(-x, F.lit(0.0)))
    mean = lambda a: F.aggregate(F.slice(a, 1, n), F.lit(0.0), lambda s, x: s + x) / n
    value = lambda u, d: F.when(d == 0, 100.0).otherwise(100 - 100 / (1 + u / d))
    start = F.struct(mean(up).alias("u"), mean(down).alias("d"), F.array(value(mean(up), mean(down))).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        u, d = (acc["u"] * (n - 1) + pair["u"]) / n, (acc["d"] * (n - 1) + pair["d"]) / n
        return F.struct(u.alias("u"), d.alias("d"), F.concat(acc["out"], F.array(value(u, d))).alias("out"))

    pairs = F.slice(F.zip_with(up, down, lambda u, d: F.struct(u.alias("u"), d.alias("d"))), n + 1, F.greatest(F.size(changes) - n, F.lit(0)))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def ema(values: Column, n: int) -> Column:
    """Exponential means after each value, seeded by the first."""
    a = 2.0 / (n + 1)
    first = F.array(F.get(values, F.lit(0)))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), first, lambda out, x: F.concat(out, F.array(F.element_at(out, -1) * (1 - a) + x * a)))


def macd_dif(closes: Column) -> Column:
    return F.zip_with(ema(closes, 12), ema(closes, 26), lambda x, y: x - y)


def macd_histogram(dif: Column) -> Column:
    return F.zip_with(dif, ema(dif, 9), lambda x, y: (x - y) * 2)


def wave_score(windows: DataFrame) -> DataFrame:
    """status, gate, score, signal and the matched components of jobs with their look-back bars."""
    bars = F.col("bars")
    field = lambda name: F.transform(bars, lambda b: b[name].cast("double"))
    rows = windows.withColumns({"c": field("close_ticks"), "h": field("high_ticks"), "l": field("low_ticks"), "v": field("volume"), "n": F.size("bars")})
    short = rows.filter(F.col("n") < LEAST_BARS).select("symbol", "as_of", "n", F.lit("INSUFFICIENT_DATA").alias("status"), F.lit(False).alias("gate"), F.lit(0).alias("score"), F.lit("NONE").alias("signal"), F.lit("").alias("matched"))
    rows = rows.filter(F.col("n") >= LEAST_BARS)
    rows = rows.withColumns({"rsi": rsi(F.col("c")), "dif": macd_dif(F.col("c"))}).withColumn("hist", macd_histogram(F.col("dif")))
    back = lambda name, i: F.element_at(F.col(name), -1 - i)
    tail = lambda name, n, skip=0: F.slice(F.col(name), F.size(name) - (n + skip) + 1, n)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    ma = lambda n, skip=0: mean(tail("c", n, skip))
    c = back("c", 0)
    gates = [c / back("c", 20) - 1 <= -0.08, c / F.array_max(tail("h", 60)) - 1 <= -0.15, (ma(10) < ma(20)) & (ma(20) < ma(20, 5))]
    swing = lambda i: (F.get("l", i) <= F.get("l", i - 1)) & (F.get("l", i) <= F.get("l", i + 1)) & (F.get("l", i) <= F.get("l", i - 2)) & (F.get("l", i) <= F.get("l", i + 2))
    rows = rows.withColumn("lows", F.filter(F.sequence(F.greatest(F.lit(2), F.col("n") - 45), F.col("n") - 3), swing))
    rows = rows.withColumns({"p": F.when(F.size("lows") >= 2, F.element_at("lows", -2)), "q": F.when(F.size("lows") >= 2, F.element_at("lows", -1))})
    lp, lq = F.get("l", F.col("p")), F.get("l", F.col("q"))
    neck = F.array_max(F.slice("h", F.col("p") + 1, F.col("q") - F.col("p") + 1))
    bottom = (F.col("q") - F.col("p")).between(5, 30) & ((lq >= 1.005 * lp) | ((F.abs(lq / lp - 1) <= 0.03) & (back("h", 0) >= neck)))
    volume = mean(tail("v", 5, 1))
    tests = {
        "RSI_TURN": (F.array_min(tail("rsi", 5)) <= 35) & (back("rsi", 0) > back("rsi", 1)),
        "MACD_CONTRACTION": (back("hist", 0) <= 0) & (back("hist", 0) > back("hist", 1)) & (back("hist", 1) > back("hist", 2)),
        "NO_NEW_LOW": back("l", 0) > F.array_min(tail("l", 4, 1)),
        "BOTTOM_STRUCTURE": bottom,
        "MA_RECOVERY": (c > ma(10)) & (ma(10) >= ma(10, 5)),
        "SHORT_PRESSURE_MA5": (c > F.array_max(tail("h", 10, 1))) & (c > ma(5)),
        "VOLUME_CONFIRM": (volume > 0) & (back("v", 0) >= 1.2 * volume),
    }
    met = {k: F.coalesce(t, F.lit(False)) for k, t in tests.items()}
    score = sum((F.when(t, POINTS[k]).otherwise(0) for k, t in met.items()), F.lit(0))
    open_ = sum((F.coalesce(g, F.lit(False)).cast("int") for g in gates), F.lit(0)) >= 2
    rows = rows.withColumns({"gate": open_, "score": score, "matched": F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in met.items()])), ",")})
    signal = F.when(F.col("gate") & (F.col("score") >= STRONG), "STRONG").when(F.col("gate") & (F.col("score") >= CANDIDATE), "CANDIDATE").otherwise("NONE")
    done = rows.select("symbol", "as_of", "n", F.lit("COMPLETED").alias("status"), "gate", "score", signal.alias("signal"), "matched")
    return done.unionByName(short)
