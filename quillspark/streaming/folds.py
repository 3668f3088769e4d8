"""What is remembered of each person, step by step: one definition, run as a stream with keyed state or over a batch.

A fold sees a person's events (``ts``, ``tie``, ``kind``, ``what``, ``n``) one by one in the order of ``ts`` and ``tie`` and keeps a
few named slots, each with a text, a number and a time. The stream holds events back until the watermark has passed them,
so they are taken in order however they arrive, and equals the batch but for what is later than the watermark; a person's
slots go when the last event is ``life`` ago. Events without a time or person are left out. Repeated rows are taken as often
as they come.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillspark.streaming.stateful import learn

SECOND = 1_000_000
#: Fixed values, in seconds: how long a question counts as repeated, can be followed up or recalled, an answer can be
#: thanked for, a question asked back is open; how long away is a return.
REPEAT, FOLLOW_UP, THANKS, ASK_BACK, RECALL = 600, 300, 300, 300, 1800
AWAY_FROM, AWAY_TO = 3 * 3600, 30 * 86400
EVENT = "ts timestamp, tie long, kind string, what string, n long"


class Event(NamedTuple):
    at: int  # microseconds
    tie: int
    kind: str | None
    what: str | None
    n: int | None


class Slot(NamedTuple):
    what: str
    n: int
    at: int


Step = Callable[[dict[str, Slot], Event], list[tuple]]


@dataclass(frozen=True)
class Fold:
    """``step`` changes the slots and gives rows of ``columns``; without ``life`` (seconds) slots stay for good."""

    step: Step
    columns: str
    life: int | None = None


def visits() -> Fold:
    """Of each message: is it the last question again, what it may follow up, thank for, reply to, or recall, and is the person back.

    Kinds are ``ask`` (what: the question), ``answer`` (what: the project), ``ask_back``; others are messages that are kept nowhere.
    """

    def step(slots: dict[str, Slot], e: Event) -> list[tuple]:
        def within(slot: str, seconds: int) -> str | None:
            s = slots.get(slot)
            return s.what if s and e.at - s.at < seconds * SECOND else None

        seen = slots.get("seen")
        back = bool(seen) and AWAY_FROM * SECOND <= e.at - seen.at <= AWAY_TO * SECOND
        repeat = e.kind == "ask" and bool(e.what) and within("ask", REPEAT) == e.what
        row = (repeat, within("ask", FOLLOW_UP), within("answer", THANKS), within("ask_back", ASK_BACK) is not None, within("ask", RECALL), back)
        if e.kind == "ask_back" or e.kind in ("ask", "answer") and e.what:
            slots[e.kind] = Slot(e.what or "", 0, e.at)
        slots["seen"] = Slot("", 0, e.at)
        return [row]

    return Fold(step, "is_repeat boolean, follows string, thanked string, awaited boolean, recalled string, back boolean", AWAY_TO)


def visits_batch(events: DataFrame, key: str) -> DataFrame:
    """The rows of ``visits`` over a batch, by windows alone: the last event of each kind before, and how long ago."""
    w = Window.partitionBy(key).orderBy("ts", "tie").rowsBetween(Window.unboundedPreceding, -1)
    at = F.unix_micros("ts")
    known = (F.col("kind") == "ask_back") | (F.col("kind").isin("ask", "answer") & (F.coalesce("what", F.lit("")) != ""))
    rows = events.where(f"{key} is not null and ts is not null").withColumn("at", at)
    last = lambda kind: F.last(F.when(known & (F.col("kind") == kind), F.struct(F.coalesce("what", F.lit("")).alias("what"), "at")), ignorenulls=True).over(w)
    rows = rows.withColumns({f"_{k}": last(k) for k in ("ask", "answer", "ask_back")} | {"_seen": F.last("at").over(w)})
    within = lambda kind, seconds: F.when(F.col("at") - F.col(f"_{kind}.at") < seconds * SECOND, F.col(f"_{kind}.what"))
    away: Column = F.col("at") - F.col("_seen")
    return rows.select(
        key, "ts", "tie", F.coalesce((F.col("kind") == "ask") & (F.col("what") != "") & (within("ask", REPEAT) == F.col("what")), F.lit(False)).alias("is_repeat"),
        within("ask", FOLLOW_UP).alias("follows"), within("answer", THANKS).alias("thanked"), within("ask_back", ASK_BACK).isNotNull().alias("awaited"),
        within("ask", RECALL).alias("recalled"), F.coalesce(away.between(AWAY_FROM * SECOND, AWAY_TO * SECOND), F.lit(False)).alias("back"),
    )


def throttle(pauses: dict[str, int], quiet: tuple[str, ...] = ()) -> Fold:
    """Events that may pass: of each kind one in so many milliseconds; other kinds always. A kind in ``quiet`` needs the pause since the last event, passed or not."""

    def step(slots: dict[str, Slot], e: Event) -> list[tuple]:
        if e.kind not in pauses:
            return [(e.kind,)]
        last = slots.get(e.kind)
        passes = last is None or e.at - last.at >= pauses[e.kind] * 1000
        if passes or e.kind in quiet:
            slots[e.kind] = Slot("", 0, e.at)
        return [(e.kind,)] if passes else []

    return Fold(step, "kind string", max(pauses.values(), default=0) // 1000 + 1)


def milestones(steps: dict[str, list[int]]) -> Fold:
    """``stat, reached`` to celebrate: ``what`` is a statistic, ``n`` its value. The first value only says where a person is; one for each check (events of one ``ts``)."""

    def step(slots: dict[str, Slot], e: Event) -> list[tuple]:
        done = slots.get("#check")
        if e.what not in steps or e.n is None or (done and done.at == e.at):
            return []
        reached = sum(e.n >= s for s in steps[e.what])
        known = slots.get(e.what)
        if known and reached <= known.n:
            return []
        slots[e.what] = Slot("", reached, e.at)
        if not known or not reached:
            return []
        slots["#check"] = Slot("", 0, e.at)
        return [(e.what, sorted(steps[e.what])[reached - 1])]

    return Fold(step, "stat string, reached long")


def interests(kept: int = 3, cap: int = 50) -> Fold:
    """``interests`` (``project:n`` by n) after each change: a question about a project counts one; thanks count one more for the project answered last, within its time, and ``wrong`` one less."""

    def step(slots: dict[str, Slot], e: Event) -> list[tuple]:
        answered = slots.get("#answer")
        if e.kind == "answer" and e.what:
            slots["#answer"] = Slot(e.what, 0, e.at)
        if e.kind in ("thanks", "wrong"):
            project, amount = answered.what if answered and e.at - answered.at < THANKS * SECOND else None, 1 if e.kind == "thanks" else -1
        else:
            project, amount = (e.what or None) if e.kind == "ask" else None, 1
        if project is None:
            return []
        counts = learn({k: s.n for k, s in slots.items() if k != "#answer"}, project, amount, kept, cap)
        for k in [k for k in slots if k != "#answer" and k not in counts]:
            del slots[k]
        for k, n in counts.items():
            slots[k] = Slot("", n, e.at)
        return [(" ".join(f"{k}:{n}" for k, n in counts.items()),)]

    return Fold(step, "interests string")


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(",")]


def _plain(v):
    return None if v is None or v is pd.NaT or v != v else v


def _events(f: pd.DataFrame, micros: str) -> Iterator[Event]:
    for at, tie, kind, what, n in zip(f[micros], f["tie"], f["kind"], f["what"], f["n"]):
        n = _plain(n)
        yield Event(int(at), int(tie), _plain(kind), _plain(what), None if n is None else int(n))


def _ready(events: DataFrame, key: str) -> DataFrame:
    return events.where(f"{key} is not null and ts is not null").select(key, "ts", F.coalesce("tie", F.lit(0)).cast("long").alias("tie"), "kind", "what", F.col("n").cast("long").alias("n"))


def _out(events: DataFrame, key: str, fold: Fold) -> str:
    return f"{key} {events.schema[key].dataType.simpleString()}, ts timestamp, tie long, {fold.columns}"


def _frame(rows: list[tuple], key: str, fold: Fold) -> pd.DataFrame:
    """Times as UTC, which Spark turns into its session's zone."""
    f = pd.DataFrame(rows, columns=[key, "ts", "tie", *_names(fold.columns)], dtype=object)
    f["ts"] = pd.to_datetime(f["ts"].astype("int64"), unit="us", utc=True)
    return f


def fold_batch(events: DataFrame, key: str, fold: Fold) -> DataFrame:
    """``key, ts, tie`` and the fold's columns. Persons pass one after the other through sorted partitions, in batches: only one's slots are in memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, slots = None, {}
        for f in frames:
            out = []
            for k, e in zip(f[key], _events(f, "at")):
                if k != who:
                    who, slots = k, {}
                out += [(k, e.at, e.tie, *row) for row in fold.step(slots, e)]
            yield _frame(out, key, fold)

    rows = _ready(events, key).withColumn("at", F.unix_micros("ts"))
    return rows.repartition(key).sortWithinPartitions(key, "at", "tie").mapInPandas(run, _out(events, key, fold))


class InOrder(StatefulProcessor):
    """Keeps events until the watermark has passed them, then takes them in order through the fold."""

    def __init__(self, key: str, fold: Fold):
        self.key, self.fold = key, fold

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot string", "what string, n long, at long")
        self.waiting = handle.getListState("waiting", "at long, tie long, kind string, what string, n long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            f = f.assign(at=f["ts"].astype("datetime64[us]").astype("int64"))
            new = [tuple(e) for e in _events(f, "at")]
            self.waiting.appendList(new)
            first = min([e[0] for e in new] + ([] if first is None else [first]), default=None)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))  # more timers than needed do no harm: the rest is set when one ends
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((Event(*e) for e in self.waiting.get()), key=lambda e: e[:2]) if self.waiting.exists() else []
        now, later = [e for e in held if e.at <= until], [e for e in held if e.at > until]
        before = {k[0]: Slot(*v) for k, v in self.slots.iterator()} if self.slots.exists() else {}
        slots, out = dict(before), []
        for e in now:
            out += [(key[0], e.at, e.tie, *row) for row in self.fold.step(slots, e)]
        if now:
            self.last.update((now[-1].at,))
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-later[0].at // 1000))
        life = self.fold.life
        ends = self.last.get()[0] + life * SECOND if life is not None and self.last.exists() else None
        if ends is not None and ends < until and not later:
            slots = {}
            self.last.clear()
        elif ends is not None:
            self.handle.registerTimer(max(-(-ends // 1000), until // 1000) + 1)
        for k in before.keys() - slots.keys():
            self.slots.removeKey((k,))
        for k, v in slots.items():
            if before.get(k) != v:
                self.slots.updateValue((k,), tuple(v))
        if out:
            yield _frame(out, self.key, self.fold)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, key: str, fold: Fold, late: str = "1 minute") -> DataFrame:
    """The same on a stream; its session needs RocksDB as state store (``spark.sql.streaming.stateStore.providerClass``)."""
    keyed = _ready(events, key).withWatermark("ts", late).groupBy(key)
    return keyed.transformWithStateInPandas(InOrder(key, fold), _out(events, key, fold), "append", "eventTime")
