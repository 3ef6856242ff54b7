"""Streams with keyed state and timers: which ticks count, the life of bars, pair events of closed bars.

State is kept by key (a worker's session, a bar, a symbol), so a micro-batch reads its own rows and their keys' state and no history.
Each rule is a plain function over one key's rows in order, which the batch form and the tests use as well.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidebar.functions.session import ORDER, slot_end, slot_of
from tidebar.streaming.ticks import CLOSE_AFTER, REVISE_DAILY_FOR, REVISE_FOR, fresh

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = ["worker_id", "session_id"]


def keyed_state(spark) -> None:
    """The state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# --- which ticks count -------------------------------------------------------------------------------------------------------------


def gate(ticks: DataFrame, now: Column, arrival: str = "arrival", max_age: int = 120) -> DataFrame:
    """ticks with verdict: DUPLICATE if the worker's session has had this sequence or a higher one before (in order of arrival), else EXPIRED
    or ACCEPTED by freshness. An expired tick raises the high-water mark too."""
    seen = F.max("worker_sequence").over(Window.partitionBy(*SESSION).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return ticks.withColumn("verdict", _verdict(seen, F.coalesce(fresh(ticks, now, max_age), F.lit(False))))


def _verdict(seen: Column, is_fresh: Column) -> Column:
    return F.when(F.col("worker_sequence") <= seen, "DUPLICATE").when(~is_fresh, "EXPIRED").otherwise("ACCEPTED")


class _Gate(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "sequence long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        held = self.mark.get()[0] if self.mark.exists() else None
        sequence = batch["worker_sequence"]
        before = sequence.cummax().shift(1)
        if held is not None:
            before = before.fillna(held).clip(lower=held)
        duplicate = sequence <= before
        batch["verdict"] = [("DUPLICATE" if d else "ACCEPTED" if f else "EXPIRED") for d, f in zip(duplicate, batch["is_fresh"])]
        top = int(sequence.max())
        self.mark.update((top if held is None else max(held, top),))
        yield batch[["worker_id", "session_id", "worker_sequence", "event_id", "verdict"]]

    def close(self) -> None:
        pass


def stream_gate(ticks: DataFrame, now: Column, arrival: str = "arrival", max_age: int = 120) -> DataFrame:
    """`gate` of a stream: worker_id, session_id, worker_sequence, event_id, verdict. The mark of a session is its state; micro-batches are
    one after the other, ticks of one batch in order of `arrival`."""
    keyed_state(ticks.sparkSession)
    rows = ticks.select(*SESSION, "worker_sequence", "event_id", F.col(arrival).alias("arrival"), F.coalesce(fresh(ticks, now, max_age), F.lit(False)).alias("is_fresh"))
    schema = rows.select(*SESSION, "worker_sequence", "event_id", F.lit("").alias("verdict")).schema
    return rows.groupBy(*SESSION).transformWithStateInPandas(statefulProcessor=_Gate(), outputStructType=schema, outputMode="Append", timeMode="None")


# --- the life of bars --------------------------------------------------------------------------------------------------------------

_BAR = "open_ticks long, open_at string, high_ticks long, low_ticks long, close_ticks long, close_at string, volume long, amount_ticks long, tick_count long, closed boolean, revision int, eob_ms long"
_BAR_OUT = "symbol string, frequency string, trading_date date, slot int, eob timestamp_ntz, open_ticks long, high_ticks long, low_ticks long, close_ticks long, volume long, amount_ticks long, tick_count long, revision int, event_type string"
BAR = ["symbol", "frequency", "trading_date", "slot"]


def _with(held: tuple | None, ticks: pd.DataFrame) -> tuple:
    """A bar (fields of _BAR up to tick_count) with more ticks; open and close go by time and event, whatever the order of arrival."""
    own = ticks.sort_values(["event_time", "event_id"])
    place = lambda r: f"{r.event_time.isoformat():<26}|{int(r.event_id):020d}"
    first, last = own.iloc[0], own.iloc[-1]
    price, volume = own["price_ticks"], own["volume"]
    new = (int(first.price_ticks), place(first), int(price.max()), int(price.min()), int(last.price_ticks), place(last), int(volume.sum()), int((price * volume).sum()), len(own))
    if held is None:
        return new
    opening, closing = min((held[1], held[0]), (new[1], new[0])), max((held[5], held[4]), (new[5], new[4]))
    return (opening[1], opening[0], max(held[2], new[2]), min(held[3], new[3]), closing[1], closing[0], held[6] + new[6], held[7] + new[7], held[8] + new[8])


class _Bars(StatefulProcessor):
    """BarUpdated for what a batch does to an open bar, BarClosed CLOSE_AFTER seconds after its end by the stream's clock (a timer, or a tick
    received later), BarRevised for ticks received within the revision window after that; when the window ends a second timer removes the
    state, and later ticks change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", _BAR)

    def _row(self, key, bar: tuple, event: str) -> pd.DataFrame:
        eob = datetime.fromtimestamp(bar[11] / 1000, UTC).replace(tzinfo=None)
        return pd.DataFrame([(*key, eob, bar[0], bar[2], bar[3], bar[4], bar[6], bar[7], bar[8], bar[10], event)], columns=[c.split()[0] for c in _BAR_OUT.split(", ")])

    def _window(self, key) -> int:
        return 1000 * (CLOSE_AFTER + (REVISE_DAILY_FOR if key[1] == "1d" else REVISE_FOR))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows))
        bar = tuple(self.bar.get()) if self.bar.exists() else None
        eob = int(pd.Timestamp(ticks["eob"].iloc[0]).timestamp() * 1000)
        shut, over = eob + 1000 * CLOSE_AFTER, eob + self._window(key)
        # a tick counts at the time it is received, whatever batch it comes in, but not before the stream's clock
        at = ticks["clock_ms"].clip(lower=timerValues.getCurrentWatermarkInMs())
        early, late = ticks[at < shut], ticks[(at >= shut) & (at < over)]
        if bar is None and len(early) + len(late):
            self.handle.registerTimer(shut)
            self.handle.registerTimer(over)
        out = []
        if len(early):
            bar = (*_with(bar and bar[:9], early), False, 0, eob)
            out.append(self._row(key, bar, "BarUpdated"))
        if len(late):
            if bar is not None and not bar[9]:
                out.append(self._row(key, (*bar[:9], True, *bar[10:]), "BarClosed"))
            # the first tick of a bar may come after its end; then the bar closes with it
            event, revision = ("BarClosed", 0) if bar is None else ("BarRevised", bar[10] + 1)
            bar = (*_with(bar and bar[:9], late), True, revision, eob)
            out.append(self._row(key, bar, event))
        if out:
            self.bar.update(bar)
            yield pd.concat(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.bar.exists():
            return
        bar = tuple(self.bar.get())
        if expiredTimerInfo.getExpiryTimeInMs() >= bar[11] + self._window(key):
            self.bar.clear()
        elif not bar[9]:
            bar = (*bar[:9], True, *bar[10:])
            self.bar.update(bar)
            yield self._row(key, bar, "BarClosed")

    def close(self) -> None:
        pass


def stream_bars(ticks: DataFrame, frequencies: tuple[str, ...] = ("1m", "5m"), clock: str = "received_at", behind: str = "0 seconds") -> DataFrame:
    """Events of the bars of a stream of ticks. The stream's clock is when ticks are received (`clock`, a timestamp): it closes the bar of a symbol that
    went silent as soon as any other tick shows that the time is over, and lets in late ticks within the revision window."""
    keyed_state(ticks.sparkSession)
    rows = ticks.withColumn("clock", F.col(clock).cast("timestamp")).withWatermark("clock", behind)
    slot = lambda f: slot_of(F.col("minute"), f)
    spans = F.array(*[F.struct(F.lit(f).alias("frequency"), slot(f).alias("slot"), slot_end(F.col("trading_date"), slot(f), f).alias("eob")) for f in frequencies])
    rows = rows.select("symbol", "trading_date", "event_time", "event_id", "price_ticks", "volume", "clock", F.unix_millis("clock").alias("clock_ms"), F.explode(spans).alias("_f")).select("*", "_f.*").drop("_f")
    return rows.groupBy(*BAR).transformWithStateInPandas(statefulProcessor=_Bars(), outputStructType=_BAR_OUT, outputMode="Update", timeMode="EventTime")


# --- pair events of closed bars ----------------------------------------------------------------------------------------------------

_EVENT = "side string, ticks long, pair_kind string, generation int, discovered_at string, last_hit_at string, hits_5m int, observed_at string, focused_at string, established_at string, active boolean"
_MOVES = "event_key string, symbol string, side string, ticks long, pair_kind string, generation int, to_stage string, at timestamp_ntz, reason string, notify boolean, break_ticks long"
#: Of each longer frequency: the stage that a bar with the event's price leads to, what has to be before it, and why.
_STEPS = {"30m": (7, None, "OBSERVING", "SAME_PRICE_30M"), "60m": (8, 7, "FOCUS", "SAME_PRICE_60M"), "1d": (9, 8, "ESTABLISHED", "SAME_PRICE_1D")}
SIDES = ("TOP", "BOTTOM")


def kind_of(ticks: int) -> str | None:
    """`pairs.pair_kind` of one price."""
    code = ticks % 100
    return None if ticks <= 0 else "ROUND_00" if code == 0 else "DOUBLE_DIGIT" if code % 11 == 0 else None


def event_key(symbol: str, side: str, ticks: int, discovered_at: str) -> str:
    return hashlib.sha256(f"{symbol}|{side}|{ticks}|{discovered_at}".encode()).hexdigest()


class Levels:
    """The pair events of one symbol: per side its active levels in the order of their prices, the latest event of each level, the last bar of
    each frequency."""

    def __init__(self, symbol: str, events: dict[tuple, list], last: dict[str, str]):
        """events: (side, ticks) -> fields of _EVENT; last: frequency -> end of its last bar."""
        self.symbol, self.events, self.last = symbol, events, last
        self.active = {side: sorted(t for (s, t), e in events.items() if s == side and e[10]) for side in SIDES}
        self.changed: set[tuple] = set()

    def _move(self, e: list, stage: str, at: str, reason: str, notify: bool, price: int | None = None) -> tuple:
        side, ticks, kind, generation, discovered = e[:5]
        self.changed.add((side, ticks))
        return (event_key(self.symbol, side, ticks, discovered), self.symbol, side, ticks, kind, generation, stage, at, reason, notify, price)

    def apply(self, frequency: str, eob: str, high: int, low: int) -> Iterator[tuple]:
        """Transitions that one closed bar causes. A bar that ends before the last one of its frequency, or a longer one before the last
        5-minute bar, comes too late: it changes nothing and asks for the symbol to be computed anew."""
        if eob < max(self.last.get(frequency, ""), self.last.get("5m", "")):
            yield (None, self.symbol, None, None, None, None, "RECOMPUTE", eob, f"LATE_{frequency}", False, None)
            return
        self.last[frequency] = eob
        if frequency == "5m":
            yield from self._five(eob, high, low)
            return
        place, needed, stage, reason = _STEPS[frequency]
        for side, price in zip(SIDES, (high, low)):
            e = self.events.get((side, price))
            if e and e[10] and e[place] is None and (needed is None or e[needed] is not None):
                e[place] = eob
                yield self._move(e, stage, eob, reason, True)

    def _five(self, eob: str, high: int, low: int) -> Iterator[tuple]:
        tops, bottoms = self.active["TOP"], self.active["BOTTOM"]
        gone = {"TOP": tops[: bisect_left(tops, high)], "BOTTOM": bottoms[bisect_right(bottoms, low) :]}
        for side, price in zip(SIDES, (high, low)):
            for ticks in gone[side]:
                e = self.events[side, ticks]
                e[10] = False
                yield self._move(e, "INVALIDATED", eob, "HIGHER_PRICE_BREAK" if side == "TOP" else "LOWER_PRICE_BREAK", e[7] is not None, price)
        del tops[: len(gone["TOP"])]
        del bottoms[len(bottoms) - len(gone["BOTTOM"]) :]
        for side, price in zip(SIDES, (high, low)):
            kind = kind_of(price)
            if kind is None:
                continue
            e = self.events.get((side, price))
            if e and e[10]:
                e[5], e[6] = eob, e[6] + 1
                self.changed.add((side, price))
                continue
            e = self.events[side, price] = [side, price, kind, e[3] + 1 if e else 1, eob, eob, 1, None, None, None, True]
            insort(self.active[side], price)
            yield self._move(e, "DISCOVERED", eob, "FIVE_MINUTE_DISCOVERY", False)


class _PairEvents(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "side string, ticks long", _EVENT)
        self.last = handle.getMapState("last", "frequency string", "eob string")
        self.seen = handle.getMapState("seen", "event_id string", "eob string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows))
        bars["_order"] = bars["frequency"].map(ORDER)
        bars = bars[bars["_order"].notna()].sort_values(["eob", "_order", "event_id"])
        levels = Levels(key[0], {(k[0], k[1]): list(v) for k, v in self.events.iterator()}, {k[0]: v[0] for k, v in self.last.iterator()})
        moves = []
        for b in bars.itertuples():
            eob = pd.Timestamp(b.eob).strftime("%Y-%m-%d %H:%M:%S")
            if self.seen.containsKey((b.event_id,)):
                continue
            self.seen.updateValue((b.event_id,), (eob,))
            moves.extend(levels.apply(b.frequency, eob, int(b.high_ticks), int(b.low_ticks)))
        for k in levels.changed:
            self.events.updateValue(k, tuple(levels.events[k]))
        for frequency, eob in levels.last.items():
            self.last.updateValue((frequency,), (eob,))
        self._forget(levels.last.get("5m"))
        if moves:
            out = pd.DataFrame(moves, columns=[c.split()[0] for c in _MOVES.split(", ")])
            out["at"] = pd.to_datetime(out["at"])
            yield out.astype({"ticks": "Int64", "generation": "Int32", "break_ticks": "Int64"})

    def _forget(self, last: str | None) -> None:
        """Ids older than KNOWN_DAYS before the last bar; a bar as old would be too late anyway."""
        if last:
            bound = (datetime.fromisoformat(last) - timedelta(days=KNOWN_DAYS)).strftime("%Y-%m-%d %H:%M:%S")
            for (event_id,) in [k for k, v in self.seen.iterator() if v[0] < bound]:
                self.seen.removeKey((event_id,))

    def close(self) -> None:
        pass


#: For how many days before a symbol's last bar its processed ids are remembered.
KNOWN_DAYS = 5


def stream_pair_events(bars: DataFrame) -> DataFrame:
    """Transitions of pair events from a stream of closed bars (symbol, frequency, eob, high_ticks, low_ticks, event_id), in the columns of
    `pairs.lifecycle` with the event's level: what a replay of the same bars gives if each symbol's bars come in the order of
    their ends. An event_id that comes again changes nothing. A bar that comes too late gives a RECOMPUTE row (without event_key) that
    names its symbol and end, and changes nothing: `recovery.recompute` brings such ranges up to date."""
    keyed_state(bars.sparkSession)
    rows = bars.select("symbol", "frequency", "eob", "high_ticks", "low_ticks", F.col("event_id").cast("string").alias("event_id"))
    return rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=_PairEvents(), outputStructType=_MOVES, outputMode="Append", timeMode="None")
