"""Sequential behaviour: as streams with keyed state, and the same over a batch in one ordered pass a key."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accepted(times: list[int], gap: int, last: int | None = None) -> tuple[list[bool], int | None]:
    """Which of the ordered times come at least ``gap`` after the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        last = t if ok else last
        out.append(ok)
    return out, last


def cooldown_batch(events: DataFrame, gap: int, key: str = "user_id", at: str = "at", tie: str = "event_id") -> DataFrame:
    """Rows that the cooldown lets through. One key at a time passes a partition sorted by it, in batches, so memory doesn't grow with a key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = None, None
        for f in frames:
            keep = []
            for k, t in zip(f[key], f[at]):
                if k != who:
                    who, last = k, None
                (ok,), last = accepted([t], gap, last)
                keep.append(ok)
            yield f[keep]

    return events.repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(run, events.schema)


def cooldown_stream(events: DataFrame, gap_seconds: int, late: str = "1 minute", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same on a stream: ``key, ts`` of accepted messages. State is the last accepted time; it goes when the watermark is past the cooldown."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        seen = pd.concat(list(frames)).sort_values(ts)
        flags, last = accepted(seen[ts].astype("datetime64[us]").astype("int64").tolist(), gap_seconds * 1_000_000, last)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * sum(flags), ts: seen[ts][flags]})

    out = events.select(key, ts).withWatermark(ts, late).groupBy(key)
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {ts} {events.schema[ts].dataType.simpleString()}"
    return out.applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def merged_answers(events: DataFrame, gap: str = "10 seconds", late: str = "1 minute", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Replies close together as one answer: session windows behind a watermark."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("replies"))


def learn(counts: dict[str, int], project: str, amount: int = 1, kept: int = 3, cap: int = 50) -> dict[str, int]:
    """Interest counts after one more question: all are halved when one passes the cap, and only the first few stay."""
    new = dict(counts)
    new[project] = max(0, new.get(project, 0) + amount)
    if max(new.values()) > cap:
        new = {k: v // 2 for k, v in new.items()}
    best = sorted((k for k, v in new.items() if v > 0), key=lambda k: (new[k], k), reverse=True)[:kept]
    return {k: new[k] for k in best}


def interests_batch(events: DataFrame, key: str = "user_id", project: str = "project", order: str = "at") -> DataFrame:
    """``key, project, n``: interest counts after all of a person's questions, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, counts = None, {}
        for f in frames:
            out = []
            for k, p in zip(f[key], f[project]):
                if k != who:
                    out += [(who, a, n) for a, n in counts.items()]
                    who, counts = k, {}
                counts = learn(counts, p)
            yield pd.DataFrame(out, columns=[key, project, "n"])
        yield pd.DataFrame([(who, a, n) for a, n in counts.items()], columns=[key, project, "n"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {kinds[key]}, {project} {kinds[project]}, n long")


def quiz_stream(asked: DataFrame, answered: DataFrame, seconds: int = 120, late: str = "10 minutes") -> DataFrame:
    """Answers with the questions of the same player at most ``seconds`` before: a join of two streams within an interval.

    Both have (user_id, ts); state is kept until the watermark has passed the interval.
    """
    a = asked.select(F.col("user_id"), F.col("ts").alias("asked_at")).withWatermark("asked_at", late).alias("a")
    b = answered.select(F.col("user_id"), F.col("ts").alias("answered_at")).withWatermark("answered_at", late).alias("b")
    near = F.expr(f"a.user_id = b.user_id AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {seconds} SECONDS")
    return a.join(b, near).select("a.user_id", "asked_at", "answered_at")
