"""Strategy signals: event types, opportunities, thresholds, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = [75, 80, 85, 90, 95]


def classify_signals(signals: DataFrame, gain: int = 2, within: int = 5) -> DataFrame:
    """Event type against the previous signal of day, symbol and strategy: New; Revised (another source watermark within `within`
    seconds); Strengthened (score risen by `gain`, or a higher action); else Repeated. action and watermark are optional columns."""
    w = Window.partitionBy("symbol", "strategy_code", "trading_date").orderBy("observed_at", "signal_id")
    lag = lambda c: F.lag(c).over(w)
    up = F.col("score") >= lag("score") + gain
    if "action" in signals.columns:
        rank = lambda c: F.coalesce(F.when(c == "CONFIRM", 2).when(c == "CANDIDATE", 1), F.lit(0))
        up = up | (rank(F.col("action")) > rank(lag("action")))
    kind = F.when(lag("score").isNull(), "New")
    if "watermark" in signals.columns:
        kind = kind.when((F.col("watermark") != lag("watermark")) & (F.timestamp_diff("SECOND", lag("observed_at"), F.col("observed_at")) <= within), "Revised")
    return signals.withColumn("event_type", kind.when(up, "Strengthened").otherwise("Repeated"))


def expiries(aged: DataFrame) -> DataFrame:
    """A row for each detail whose aged status is not what is stored."""
    return aged.filter(F.col("aged_status") != F.col("status")).select("symbol", "strategy_code", "trading_date", F.col("status").alias("from_status"), F.col("aged_status").alias("to_status"))


def level(active: Column, score: Column) -> Column:
    return F.when(((active >= 2) & (score >= 85)) | (score >= 95), "focus").when((active >= 2) | (score >= 90), "candidate").otherwise("observe")


def opportunities(signals: DataFrame) -> DataFrame:
    """Per symbol and day: strategies, best active score, primary strategy (score, then code), level, status."""
    one = signals.groupBy("symbol", "trading_date", "strategy_code").agg(
        F.max("score").alias("score"), F.count("*").alias("hits"), F.max_by("status", F.struct("observed_at", "signal_id")).alias("status"),
        F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"),
    )
    active = F.col("status") == "active"
    rows = one.groupBy("symbol", "trading_date").agg(
        F.count_if(active).alias("active_strategies"), F.count("*").alias("strategies"), F.sum("hits").alias("hits"), F.max(F.when(active, F.col("score"))).alias("best_score"),
        F.min(F.when(active, F.struct((-F.col("score")).alias("s"), "strategy_code"))).alias("p"), F.max((F.col("status") == "weakened").cast("int")).alias("weak"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )
    status = F.when(F.col("active_strategies") > 0, "active").when(F.col("weak") == 1, "weakened").otherwise("expired")
    return rows.withColumns({"primary_strategy": F.col("p.strategy_code"), "level": level(F.col("active_strategies"), F.coalesce("best_score", F.lit(0))), "status": status}).drop("p", "weak")


def first_crossings(signals: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """First signal of day, symbol and strategy at or above each threshold."""
    rows = signals.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("score") >= F.col("threshold"))
    first = F.min(F.struct("observed_at", "signal_id", "score"))
    return rows.groupBy("symbol", "strategy_code", "trading_date", "threshold").agg(first.alias("f")).select("symbol", "strategy_code", "trading_date", "threshold", "f.*")


def train_split(signals: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Chronological split by distinct date."""
    dates = signals.select("trading_date").distinct()
    w = Window.orderBy("trading_date")
    part = dates.withColumn("segment", F.when(F.row_number().over(w) <= F.lit(dates.count() * ratio), "train").otherwise("validation"))
    return signals.join(part, "trading_date")


HORIZONS = ("d1", "d3", "d5", "w1")


def calibration(outcomes: DataFrame) -> DataFrame:
    """Samples, win rate and mean return of each horizon, and mean best and worst of five days, by strategy, threshold and segment, with the
    segment `all`."""
    both = outcomes.withColumn("segment", F.explode(F.array("segment", F.lit("all"))))
    each = [x for h in HORIZONS for x in (F.count(h).alias(f"samples_{h}"), F.avg((F.col(h) > 0).cast("int")).alias(f"win_rate_{h}"), F.avg(h).alias(f"mean_{h}"))]
    return both.groupBy("strategy_code", "threshold", "segment").agg(*each, F.avg("mfe5").alias("mean_mfe5"), F.avg("mae5").alias("mean_mae5"))


def recommendations(calibrated: DataFrame, least: int = 20) -> DataFrame:
    """Per strategy the threshold to use: both segments with enough three-day samples, a mean above 0 and a win rate of a half at least; of
    those the best by the segments' mean return less their distance; ties go to the lower threshold."""
    part = lambda name: calibrated.filter(F.col("segment") == name).select("strategy_code", "threshold", *[F.col(f"{c}_d3").alias(f"{name}_{c}") for c in ("samples", "mean", "win_rate")])
    rows = part("train").join(part("validation"), ["strategy_code", "threshold"])
    for name in ("train", "validation"):
        rows = rows.filter((F.col(f"{name}_samples") >= least) & (F.col(f"{name}_mean") > 0) & (F.col(f"{name}_win_rate") >= 0.5))
    a, b = F.col("train_mean"), F.col("validation_mean")
    rows = rows.withColumn("objective", F.round((a + b) / 2 - F.abs(a - b), 9))
    best = F.max(F.struct("objective", (-F.col("threshold")).alias("minus"))).alias("best")
    return rows.groupBy("strategy_code").agg(best).select("strategy_code", (-F.col("best.minus")).alias("threshold"), F.col("best.objective").alias("objective"))


def filter_signals(signals: DataFrame, symbol: str | None = None, strategy: str | None = None, event_type: str | None = None, date: str | None = None) -> DataFrame:
    for column, value in (("symbol", symbol), ("strategy_code", strategy), ("event_type", event_type), ("trading_date", date)):
        if value is not None:
            signals = signals.filter(F.col(column) == F.lit(value).cast(signals.schema[column].dataType))
    return signals


def filter_opportunities(rows: DataFrame, date: str | None = None, symbol: str | None = None, level: str | None = None, status: str | None = "active") -> DataFrame:
    for column, value in (("trading_date", date), ("symbol", symbol), ("level", level), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(column) == F.lit(value).cast(rows.schema[column].dataType))
    return rows


def filter_runs(runs: DataFrame, profile: str | None = None, status: str | None = None) -> DataFrame:
    for column, value in (("profile", profile), ("status", status)):
        if value is not None:
            runs = runs.filter(F.col(column) == value)
    return runs


def with_outcome(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    return signals.join(outcomes, ["symbol", "trading_date"], "left")


def age(detail: DataFrame, now: Column, weaken: int = 6, expire: int = 18) -> DataFrame:
    """Status by minutes since last seen."""
    quiet = F.timestamp_diff("MINUTE", F.col("last_seen_at"), now)
    return detail.withColumn("aged_status", F.when(quiet >= expire, "expired").when(quiet >= weaken, "weakened").otherwise(F.col("status")))
