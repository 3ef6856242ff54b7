"""Features of a symbol's day from its one-minute bars and its history, and the published rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.daily import daily_state, decline_wave, latest_30m, percent


def with_vwap(m1: DataFrame) -> DataFrame:
    """Running VWAP of the day and the number of closes in a row at or above it."""
    w = Window.partitionBy("symbol", "trading_date").orderBy("slot")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    vwap = F.sum("amount_ticks").over(run) / F.nullif(F.sum("volume").over(run), F.lit(0))
    rows = m1.withColumns({"vwap": F.coalesce(vwap, F.col("close_ticks").cast("double")), "traded": F.sum("volume").over(run) > 0}).withColumn("n", F.row_number().over(w))
    above = F.col("traded") & (F.col("close_ticks") >= F.col("vwap"))
    return rows.withColumn("run_above", F.col("n") - F.coalesce(F.max(F.when(~above, F.col("n"))).over(run), F.lit(0)))


def day_features(m1: DataFrame) -> DataFrame:
    """One row per symbol and day as of its last bar."""
    w = Window.partitionBy("symbol", "trading_date").orderBy("slot")
    rows = with_vwap(m1)
    mean = lambda k, skip: F.avg("volume").over(w.rowsBetween(-(k - 1) - skip, -skip))
    rows = rows.withColumns(
        {
            "last5": mean(5, 0), "prior5": F.when(F.col("n") >= 10, mean(5, 5)), "rising": (F.col("volume") >= F.lag("volume").over(w)) & (F.lag("volume").over(w) >= F.lag("volume", 2).over(w)),
            "platform_high": F.max("high_ticks").over(w.rowsBetween(-15, -1)), "close_5_ago": F.lag("close_ticks", 5).over(w),
            "last3": mean(3, 0), "prior3": F.when(F.col("n") >= 6, mean(3, 3)), "last8": F.collect_list(F.struct("low_ticks", "close_ticks", "vwap")).over(w.rowsBetween(-7, 0)),
        }
    )
    last = F.max_by(F.struct("close_ticks", "vwap", "run_above", "last5", "prior5", "last3", "prior3", "last8", "rising", "platform_high", "close_5_ago", "slot"), "slot")
    day = rows.groupBy("symbol", "trading_date").agg(
        F.min_by("open_ticks", "slot").alias("day_open"), F.max("high_ticks").alias("day_high"), F.min("low_ticks").alias("day_low"), F.sum("volume").alias("volume"), F.sum("amount_ticks").alias("amount_ticks"),
        F.count("*").alias("bars"), last.alias("x"),
    )
    price, high, low, open_ = F.col("x.close_ticks"), F.col("day_high"), F.col("day_low"), F.col("day_open")
    wide = high > low
    return day.select(
        "symbol", "trading_date", "day_open", "day_high", "day_low", price.alias("price"), "volume", "amount_ticks", "bars", F.col("x.vwap").alias("vwap"), F.col("x.run_above").alias("run_above"),
        percent(price, open_).alias("from_open"), percent(price, F.col("x.vwap")).alias("above_vwap"), ((high - price) / high * 100).alias("pullback"),
        F.when(wide, (price - low) / (high - low)).otherwise(1.0).alias("close_position"), F.when(wide, (high - F.greatest(open_, price)) / (high - low)).otherwise(0.0).alias("upper_wick"),
        F.coalesce(F.when(F.col("x.prior5") > 0, F.col("x.last5") / F.col("x.prior5")), F.lit(0.0)).alias("acceleration"), F.coalesce("x.rising", F.lit(False)).alias("volume_sustained"),
        F.coalesce(F.when(F.col("x.prior3") > 0, F.col("x.last3") / F.col("x.prior3")), F.lit(0.0)).alias("recent3"), restarted(F.col("x.last8")).alias("restart"), F.col("x.slot").alias("slot"),
        percent(price, F.coalesce("x.close_5_ago", F.lit(0))).alias("return_5"), F.when(F.col("x.platform_high") > 0, percent(price, F.col("x.platform_high"))).otherwise(0.0).alias("platform_breakout"),
    )


def restarted(last8: Column) -> Column:
    """Whether one of the last eight bars, but for the last two, came back to the VWAP and held it (low within 0.3 %, close not below), the
    last two closed at or above it, and the last at least 0.2 % above that bar's close."""
    end = lambda i: F.element_at(last8, -i)
    held = lambda b: b["close_ticks"] >= b["vwap"]
    back = lambda b: (b["low_ticks"] >= b["vwap"] * 0.997) & held(b) & (percent(end(1)["close_ticks"], b["close_ticks"]) >= 0.2)
    enough = F.size(last8) >= 4
    return F.when(enough, held(end(1)) & held(end(2)) & F.exists(F.slice(last8, 1, F.greatest(F.size(last8) - 2, F.lit(0))), back)).otherwise(False)


#: Fields of a snapshot that come from the day's minutes, from its 30-minute bars and from daily history.
DAY = [
    "price", "day_open", "day_high", "day_low", "volume", "amount_ticks", "bars", "vwap", "run_above", "from_open", "above_vwap", "pullback", "close_position", "upper_wick", "acceleration", "recent3",
    "volume_sustained", "restart", "return_5", "platform_breakout",
]
M30 = ["m30_volume_ratio", "m30_close_position", "m30_upper_wick", "m30_bullish"]
HISTORY = ["ma5", "ma10", "ma20", "ma30", "ma60", "ma20_slope", "trend_strength", "pullback_volume_ratio", "support"]
WEEKS = ["platform_high", "platform_low", "range_24", "range_12", "touches"]
WAVE = ["decline", "rebound", "repair", "second_bottom", "breaks_trend"]


def snapshots(m1: DataFrame, m30: DataFrame, daily: DataFrame, market: DataFrame, least_daily: int = 60) -> DataFrame:
    """One row per symbol and day as of its last minute bar: the day so far, its last 30-minute bar, the daily bars before it, and the
    market's mean change (market: trading_date, market_change), with a hash of the sources' watermarks and a readiness."""
    day = day_features(m1)
    state = daily_state(day.select("symbol", F.col("trading_date").alias("as_of")), daily).withColumnsRenamed({"as_of": "trading_date", "bars": "history"})
    rows = day.join(latest_30m(m30), ["symbol", "trading_date"], "left").join(state, ["symbol", "trading_date"], "left").join(F.broadcast(market.select("trading_date", "market_change")), "trading_date", "left")
    none = F.lit(0.0)
    rows = rows.withColumns({c: F.coalesce(c, none) for c in (*HISTORY, *WEEKS, "m30_volume_ratio", "m30_close_position", "m30_upper_wick", "market_change")} | {"m30_bullish": F.coalesce("m30_bullish", F.lit(False))})
    price, before = F.col("price"), F.coalesce("last_close", F.lit(0))
    elapsed = F.col("slot") + 1
    rows = decline_wave(rows, "history").withColumns(
        {
            "pre_close": before, "change": percent(price, before), "gap": percent(F.col("day_open"), before), "volume_ratio": F.coalesce(F.when(F.col("mean_volume") > 0, F.col("volume") / (F.col("mean_volume") * elapsed / 240)), none),
            "five_day_return": percent(price, F.coalesce("four_ago", F.lit(0))), "distance_from_support": percent(price, F.col("support")), "relative_strength": percent(price, before) - F.col("market_change"),
            "amount": F.col("amount_ticks") / 100,
            "watermark": F.sha2(F.concat_ws("|", "symbol", F.date_format("trading_date", "yyyy-MM-dd"), F.col("slot").cast("string"), F.date_format("m30_eob", "yyyy-MM-dd HH:mm:ss"), F.date_format("bar_date", "yyyy-MM-dd")), 256),
            "readiness": F.when(F.size("history") <= 0, "NO_DAILY_BARS").when(F.size("history") < least_daily, "FEW_DAILY_BARS").otherwise("READY"),
        }
    )
    return rows


#: The published limits of the two rules.
LIMITS = {
    "turnover": 80_000_000, "minutes": 12, "rise": 0.3, "day_gain": 6.5, "candidate_low": 0.8, "confirm_low": 0.2, "pullback_high": 1.2, "candidate_run": 2, "confirm_run": 3, "candidate_pace": 1.35, "confirm_pace": 1.5,
    "recent3": 1.1, "return_5": 0.3, "breakout": 0.3, "gap_main": -2, "gap_growth": -7, "restart_rise": 2, "restart_gain": 3.5, "restart_above": 1, "restart_pullback": 1.8,
}


def rules(limits: dict[str, float] = LIMITS) -> dict[tuple[str, str], dict[str, str]]:
    """(rule, branch) -> condition name -> predicate over a snapshot, in the order of the filter's steps. growth: whether the symbol
    is of a board with wide price limits."""
    v = limits
    base = {"turnover": f"amount >= {v['turnover']}", "minutes": f"bars >= {v['minutes']}"}
    resonance = base | {"above_vwap": "price >= vwap", "from_open": f"from_open >= {v['rise']}", "day_gain": f"change <= {v['day_gain']}", "return_5": f"return_5 >= {v['return_5']}"}
    volume = {"recent3": f"recent3 >= {v['recent3']}", "sustained": "volume_sustained"}
    back = lambda low: {"pullback": f"pullback >= {low} AND pullback <= {v['pullback_high']}"}
    restart = base | {
        "low_open": f"gap < 0 AND gap >= CASE WHEN growth THEN {v['gap_growth']} ELSE {v['gap_main']} END", "from_open": f"from_open >= {v['restart_rise']}", "day_gain": f"change <= {v['restart_gain']}",
        "above_vwap": f"above_vwap >= {v['restart_above']}", "pullback": f"pullback <= {v['restart_pullback']}", "pace": f"acceleration >= {v['confirm_pace']}", "sustained": "volume_sustained",
    }
    return {
        ("vwap-volume-resonance", "candidate"): resonance | back(v["candidate_low"]) | {"run": f"run_above >= {v['candidate_run']}", "pace": f"acceleration >= {v['candidate_pace']}"} | volume,
        ("vwap-volume-resonance", "confirm"): resonance | back(v["confirm_low"]) | {"run": f"run_above >= {v['confirm_run']}", "pace": f"acceleration >= {v['confirm_pace']}"} | volume | {"breakout": f"platform_breakout >= {v['breakout']}"},
        ("gap-recovery-restart", "candidate"): restart,
        ("gap-recovery-restart", "confirm"): restart | {"restart": f"restart OR run_above >= {v['confirm_run']}"},
    }


def evaluate(features: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Per row, rule and branch: passed and failed condition names, score (share of conditions met, in percent), whether it passed."""
    each = []
    for (rule, branch), conditions in rules(limits).items():
        met = {k: F.coalesce(F.expr(c), F.lit(False)) for k, c in conditions.items()}
        names = lambda want: F.array_compact(F.array(*[F.when(c if want else ~c, F.lit(k)) for k, c in met.items()]))  # noqa: E731, B023
        share = F.size(names(True)) / len(met)
        each.append(F.struct(F.lit(rule).alias("rule"), F.lit(branch).alias("branch"), names(True).alias("met"), names(False).alias("missed"), F.round(100 * share, 4).alias("score"), (F.size(names(False)) == 0).alias("passed")))
    return features.select("symbol", "trading_date", F.inline(F.array(*each)))


def decisions(evaluations: DataFrame) -> DataFrame:
    """Per row and rule: CONFIRM if that branch passed, else CANDIDATE if that one did, else NONE; the better score."""
    passed = lambda branch: F.bool_or((F.col("branch") == branch) & F.col("passed"))
    rows = evaluations.groupBy("symbol", "trading_date", "rule").agg(passed("confirm").alias("c"), passed("candidate").alias("d"), F.max("score").alias("score"))
    return rows.withColumn("action", F.when(F.col("c"), "CONFIRM").when(F.col("d"), "CANDIDATE").otherwise("NONE")).drop("c", "d")


def funnel(evaluations: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Per rule, branch and filter step in order: how many came to it, having passed all before, and how many passed it too."""
    out = []
    for (rule, branch), conditions in rules(limits).items():
        steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(k).alias("condition"), F.array(*map(F.lit, list(conditions)[:i])).alias("before")) for i, k in enumerate(conditions)]
        out.append(F.when((F.col("rule") == rule) & (F.col("branch") == branch), F.array(*steps)))
    rows = evaluations.select("rule", "branch", "missed", F.inline(F.coalesce(*out)))
    came = ~F.arrays_overlap("missed", "before")
    return rows.filter(came).groupBy("rule", "branch", "step", "condition").agg(F.count("*").alias("evaluated"), F.count_if(~F.array_contains("missed", F.col("condition"))).alias("passed"))
