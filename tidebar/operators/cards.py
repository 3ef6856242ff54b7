"""Wave jobs, notification cards, alerts, and the joins of strategy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stage -> (severity, title).
STAGES = {"OBSERVING": ("info", "Observing"), "FOCUS": ("warning", "Focus"), "ESTABLISHED": ("critical", "Established"), "INVALIDATED": ("warning", "Invalidated")}


def _pick(column: str, values: dict, at: int, other: str) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v[at])) for k, v in values.items()], F.lit(other))


def with_notify(moves: DataFrame, now: Column) -> DataFrame:
    """Whether a bar's news is still news: its end at most two minutes ahead, and an hour ago at most (two for daily bars)."""
    age = F.timestamp_diff("SECOND", F.col("at"), now)
    most = F.when(F.col("frequency") == "1d", 7200).otherwise(3600)
    return moves.withColumn("eligible", (age >= -120) & (age <= most))


def alerts(moves: DataFrame, events: DataFrame) -> DataFrame:
    """One row a notifying transition with a deterministic id, severity, title, and what a top or bottom reminds of."""
    rows = moves.filter("notify").join(events.select("event_key", "side", "ticks"), "event_key")
    text = F.concat_ws("|", "event_key", "to_stage", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    remind = F.when(F.col("to_stage") == "INVALIDATED", "NONE").when(F.col("side") == "TOP", "SELL").otherwise("BUY")
    title = F.concat_ws(" ", "symbol", "side", _pick("to_stage", STAGES, 1, "Discovered"))
    return rows.select(F.sha2(text, 256).alias("outbox_id"), "event_key", "symbol", "to_stage", "at", _pick("to_stage", STAGES, 0, "info").alias("severity"), title.alias("title"), remind.alias("reminder"), "ticks").dropDuplicates(["outbox_id"])


def upsert_cards(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, change rows): the newest state of each task_key (by at, event_id) over the cards held; a card whose event did not change
    stays, one that changed has its revision counted up and a change row."""
    facts = [c for c in current.columns if c not in ("task_key", "revision")]
    new = batch.groupBy("task_key").agg(F.max_by(F.struct(*facts), F.struct("at", "event_id")).alias("n"))
    both = current.select("task_key", "revision", F.struct(*facts).alias("o")).join(new, "task_key", "full")
    older = F.struct("n.at", "n.event_id") <= F.struct("o.at", "o.event_id")
    changed = F.col("n").isNotNull() & (F.col("o").isNull() | ((F.col("n.event_id") != F.col("o.event_id")) & ~older))
    rows = both.select("task_key", F.when(changed, F.col("n")).otherwise(F.col("o")).alias("r"), (F.coalesce("revision", F.lit(-1)) + changed.cast("int")).alias("revision"), changed.alias("changed"))
    out = rows.select("task_key", *[F.col(f"r.{c}").alias(c) for c in facts], "revision", "changed")
    return out.drop("changed"), out.filter("changed").select("task_key", "event_id", "at", "revision")


def opportunity_cards(opportunities: DataFrame, detail: DataFrame, instruments: DataFrame, definitions: DataFrame, signals: DataFrame) -> DataFrame:
    """Opportunities with their details, names, the strategies' titles and each detail's newest signal."""
    newest = signals.groupBy("symbol", "trading_date", "strategy_code").agg(F.max_by(F.struct("signal_id", "score"), F.struct("observed_at", "signal_id")).alias("s"))
    rows = opportunities.join(detail, ["symbol", "trading_date"]).join(newest, ["symbol", "trading_date", "strategy_code"], "left")
    rows = rows.join(instruments.select("symbol", "name"), "symbol", "left").join(definitions, "strategy_code", "left")
    return rows.withColumns({"signal_id": F.col("s.signal_id"), "signal_score": F.col("s.score"), "name": F.coalesce("name", "symbol")}).drop("s")


def with_assignment(pool: DataFrame, assignments: DataFrame) -> DataFrame:
    """pool with the worker whose symbols hold the row's."""
    each = assignments.select("worker", F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.min("worker").alias("worker"))
    return pool.join(each, "symbol", "left")


def wave_jobs(events: DataFrame, done: DataFrame, version: str = "v3", before: str = "v2") -> DataFrame:
    """Bottoms to score: active ones in focus or established, and those that the version before has completed; data ends the day before the
    focus. A job of this version for the same focus time is not asked again."""
    rows = events.filter((F.col("side") == "BOTTOM") & F.col("focused_at").isNotNull())
    old = done.filter((F.col("version") == before) & (F.col("status") == "COMPLETED")).select("event_key").distinct()
    live = F.col("is_active") & F.col("stage").isin("FOCUS", "ESTABLISHED")
    asked = rows.filter(live).unionByName(rows.join(old, "event_key", "left_semi")).dropDuplicates(["event_key"])
    held = done.filter(F.col("version") == version).select("event_key", "focused_at")
    return asked.join(held, ["event_key", "focused_at"], "left_anti").select("event_key", "symbol", "focused_at", F.date_sub(F.to_date("focused_at"), 1).alias("data_end"), F.lit(version).alias("version"))


def initial_cards(opportunities: DataFrame, moves: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """What a reader sees first: the newest day's opportunities and the notifying transitions of the last 30 days, as cards."""
    newest = opportunities.agg(F.max("trading_date").alias("trading_date"))
    rows = opportunities.join(F.broadcast(newest), "trading_date")  # one row
    one = rows.select(
        F.concat_ws("|", F.lit("opportunity"), "symbol", F.date_format("trading_date", "yyyy-MM-dd")).alias("task_key"), "symbol", F.lit("opportunity").alias("kind"), F.col("level").alias("state"), F.col("last_seen_at").alias("at"),
        F.when(F.col("level") == "focus", "critical").when(F.col("level") == "candidate", "warning").otherwise("info").alias("severity"),
    )
    recent = moves.filter("notify").filter(F.col("at") >= F.date_sub(today, days).cast("timestamp_ntz"))
    two = recent.select(F.concat_ws("|", F.lit("event"), "event_key").alias("task_key"), "symbol", F.lit("event").alias("kind"), F.col("to_stage").alias("state"), "at", _pick("to_stage", STAGES, 0, "info").alias("severity"))
    two = two.groupBy("task_key").agg(F.max_by(F.struct(*two.columns[1:]), F.struct("at", "state")).alias("x")).select("task_key", "x.*")
    return one.unionByName(two)
