"""Point-in-time universe: boards, listing windows, consistency gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code prefixes of the main and growth boards by exchange.
BOARDS = r"^(SHSE\.(600|601|603|605|688)|SZSE\.(000|001|002|003|300|301))\d{3}$"
# How exact a status is, by the adapter that read it.
ADAPTERS = {"get_instruments-current-snapshot": "estimated_current_snapshot", "get_symbols": "historical_exact"}
#: A delisting date from here on means none.
NO_END = "2038-01-01"


def is_special(name: Column) -> Column:
    """Special-treatment names: ST or *ST in front, whatever the case or blanks."""
    return F.coalesce(F.upper(F.regexp_replace(name, r"\s", "")).rlike(r"^\*?ST"), F.lit(False))


def classify(raw: DataFrame) -> DataFrame:
    """raw (symbol, name, is_suspended, raw_attributes JSON) with is_a_share, is_st, is_eligible, exclusion_reason (one that raw has stays where no
    rule gives one), status_source and status_quality, both by the adapter that read the status."""
    share = F.coalesce(F.col("symbol").rlike(BOARDS), F.lit(False))
    level = F.get_json_object("raw_attributes", "$.sec_level").cast("int")
    st = F.coalesce(level.isin(2, 3), is_special(F.col("name")))
    suspended = F.coalesce("is_suspended", F.lit(False))
    reason = F.when(~share, "NOT_A_SHARE").when(st, "ST")
    if "exclusion_reason" in raw.columns:
        reason = reason.otherwise(F.col("exclusion_reason"))
    adapter = F.get_json_object("raw_attributes", "$._universe_adapter")
    quality = F.coalesce(*[F.when(adapter == a, q) for a, q in ADAPTERS.items()], F.lit("unknown"))
    return raw.withColumns({"is_a_share": share, "is_st": st, "is_eligible": share & ~st & ~suspended, "exclusion_reason": reason, "status_source": F.coalesce(adapter, F.lit("legacy_unknown")), "status_quality": quality})


def listed_on(instruments: DataFrame, day: Column) -> DataFrame:
    """Instruments listed by the day and not delisted before it."""
    end = F.when(F.col("delist_date") < F.lit(NO_END).cast("date"), F.col("delist_date"))
    return instruments.filter((F.col("list_date") <= day) & (end.isNull() | (end >= day)))


def eligible_at(universe: DataFrame, day: Column, limit: int = 10_000) -> DataFrame:
    """Eligible symbols of the newest status date not after the day, or of the newest one there is if all come after it."""
    dates = universe.agg(F.max(F.when(F.col("trading_date") <= day, F.col("trading_date"))).alias("a"), F.max("trading_date").alias("b")).select(F.coalesce("a", "b").alias("trading_date"))
    return universe.join(F.broadcast(dates), "trading_date").filter("is_eligible").select("symbol").orderBy("symbol").limit(limit)  # one row is broadcast


def search(instruments: DataFrame, text: str, limit: int = 50, exact: str | None = None) -> DataFrame:
    """Instruments whose symbol or name holds the text: eligible ones first, then the symbol that equals it (or `exact`), then by symbol."""
    found = instruments.filter(F.col("name").contains(text) | F.col("symbol").contains(text))
    return found.orderBy(F.desc("is_eligible"), (F.col("symbol") == (text if exact is None else exact)).desc(), "symbol").limit(limit)


#: Rows of a snapshot that a task of `differences` compares, about.
ROWS_A_TASK = 250_000


def differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows that one of two snapshots has more often than the other, each once with its side and copies, how many more. Rows that are alike
    meet by their key (columns) in as many tasks as there are rows for, so a task's memory does not grow with the snapshots."""
    tasks = a.count() // ROWS_A_TASK + 1
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).repartition(tasks, *key)
    more = both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return more.withColumns({"side": F.when(F.col("_n") > 0, "first").otherwise("second"), "copies": F.abs("_n")}).drop("_n")


def gate(first: DataFrame, second: DataFrame, calendar: DataFrame, other: DataFrame, bounds: tuple[int, int] = (4000, 10_000), least_eligible: int = 4500) -> DataFrame:
    """Per day of the first snapshot: rows, eligible ones, repeated symbols, rows in which two snapshots differ, and whether it passes: sizes
    within bounds, no repeats, no differences, and the day on both exchanges' calendars or on neither."""
    counted = first.groupBy("trading_date").agg(F.count("*").alias("total"), F.count_if("is_eligible").alias("eligible"), (F.count("*") - F.count_distinct("symbol")).alias("duplicates"))
    off = differences(first, second, ["trading_date", "symbol"]).groupBy("trading_date").agg(F.sum("copies").alias("differing"))
    days = calendar.select("trading_date", F.lit(1).alias("a")).join(other.select("trading_date", F.lit(1).alias("b")), "trading_date", "full")
    rows = counted.join(off, "trading_date", "left").join(days, "trading_date", "left").fillna(0, ["differing"])
    passed = F.col("total").between(*bounds) & (F.col("eligible") >= least_eligible) & (F.col("duplicates") == 0) & (F.col("differing") == 0) & F.col("a").eqNullSafe(F.col("b"))
    return rows.withColumn("passed", passed).drop("a", "b")


def readiness(certificates: DataFrame, universe: DataFrame) -> DataFrame:
    """Per certified day: counted against certified totals; ready if all agree, and a day without trading has none."""
    counted = universe.groupBy("trading_date").agg(F.count("*").alias("total"), F.count_if("is_eligible").alias("eligible"), F.count_distinct("symbol").alias("symbols"))
    rows = certificates.join(counted, "trading_date", "left").fillna(0, ["total", "eligible", "symbols"])
    agree = (F.col("total") == F.col("certified_total")) & (F.col("eligible") == F.col("certified_eligible")) & (F.col("symbols") == F.col("total"))
    return rows.withColumn("ready", F.when(F.col("is_trading_day"), agree & (F.col("total") > 0)).otherwise(agree & (F.col("total") == 0)))


def cover(expected: DataFrame, received: DataFrame, proofs: DataFrame, key: list[str], slot: str, confirmations: int = 3) -> DataFrame:
    """Verdict per key: every expected slot is received or proven missing by exactly so many reads, none is both, extra or double."""
    e = expected.groupBy(*key, slot).agg(F.count("*").alias("e"))
    r = received.groupBy(*key, slot).agg(F.count("*").alias("r"))
    p = proofs.groupBy(*key, slot).agg(F.max("confirmations").alias("p"))
    rows = e.join(r, [*key, slot], "full").join(p, [*key, slot], "full").fillna(0, ["e", "r", "p"])
    good = (F.col("e") == 1) & (((F.col("r") == 1) & (F.col("p") == 0)) | ((F.col("r") == 0) & (F.col("p") == confirmations)))
    return rows.groupBy(*key).agg(
        F.count_if(F.col("e") > 0).alias("expected"), F.count_if(F.col("r") > 0).alias("received"), F.count_if(F.col("p") > 0).alias("proven"), F.count_if(F.col("e") == 0).alias("extra"),
        F.count_if((F.col("e") > 0) & (F.col("r") == 0) & (F.col("p") == 0)).alias("unexplained"), F.bool_and(good).alias("complete"),
    )


def sparse_proof(reads: DataFrame, key: list[str], fields: list[str], least: int = 3) -> DataFrame:
    """Keys whose reads agree on every field: number of reads, of different answers, and whether that proves them."""
    answer = reads.groupBy(*key, "read_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))), 256).alias("answer"))
    return answer.groupBy(*key).agg(F.count("*").alias("reads"), F.count_distinct("answer").alias("answers")).withColumn("proven", (F.col("reads") >= least) & (F.col("answers") == 1))
