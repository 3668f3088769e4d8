"""Folds over a person's events: by hand, as a batch, and as a stream whose events arrive in any order."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import folds

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = f"user_id long, {folds.EVENT}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark, rows):
    """Rows of (user, seconds, kind, what, n)."""
    return spark.createDataFrame([(u, None if s is None else BEGIN + timedelta(seconds=s), i, k, w, n) for i, (u, s, k, w, n) in enumerate(rows)], SCHEMA)


def told(df):
    return sorted((tuple(r) for r in df.select("user_id", "tie", *[c for c in df.columns if c not in ("user_id", "ts", "tie")]).collect()), key=str)


def test_visits(spark):
    rows = [
        (1, 0, "ask", "fox den", None), (1, 10, "answer", "foxes", None), (1, 299, "ask", "fox den", None), (1, 310, "thanks", None, None), (1, 899, "ask", "fox den", None),
        (1, 900, "ask_back", None, None), (1, 1200, "talk", "", None), (1, 2698, "talk", None, None), (1, 2699, "talk", None, None), (1, 2699 + 3 * 3600, "talk", None, None), (2, 5, "ask", "", None), (2, 6, "ask", None, None),
        (None, 1, "ask", "x", None), (3, None, "ask", "x", None),
    ]
    got = {r[1]: r[2:] for r in told(folds.visits_batch(events(spark, rows), "user_id"))}
    assert got == {
        0: (False, None, None, False, None, False), 1: (False, "fox den", None, False, "fox den", False), 2: (True, "fox den", "foxes", False, "fox den", False), 3: (False, "fox den", None, False, "fox den", False),
        4: (False, None, None, False, "fox den", False), 5: (False, "fox den", None, False, "fox den", False), 6: (False, None, None, False, "fox den", False), 7: (False, None, None, False, "fox den", False),
        8: (False, None, None, False, None, False), 9: (False, None, None, False, None, True), 10: (False, None, None, False, None, False), 11: (False, None, None, False, None, False),
    }
    assert got == {r[1]: r[2:] for r in told(folds.fold_batch(events(spark, rows), "user_id", folds.visits()))}
    assert folds.fold_batch(events(spark, rows).limit(0), "user_id", folds.visits()).count() == 0


def test_throttle(spark):
    rows = [(1, 0, "hurt", None, None), (1, 30, "hurt", None, None), (1, 60, "hurt", None, None), (1, 60, "tip", None, None), (1, 60, "tip", None, None), (2, 0, "plop", None, None), (2, 0.3, "plop", None, None), (2, 0.6, "plop", None, None), (2, 1, "plop", None, None)]
    got = [r[1] for r in told(folds.fold_batch(events(spark, rows), "user_id", folds.throttle({"hurt": 60_000, "plop": 400}, ("plop",))))]
    assert got == [0, 2, 3, 4, 5, 8]


def test_milestones(spark):
    rows = [
        (1, 0, "stat", "jumps", 250), (1, 0, "stat", "deaths", 0), (1, 300, "stat", "jumps", 999), (1, 600, "stat", "jumps", 1500), (1, 600, "stat", "deaths", 12), (1, 900, "stat", "deaths", 12), (1, 900, "stat", "jumps", 1500),
        (1, 1200, "stat", "swims", 5), (1, 1200, "stat", "jumps", None), (2, 0, "stat", "jumps", 5000),
    ]
    got = told(folds.fold_batch(events(spark, rows), "user_id", folds.milestones({"jumps": [100, 1000], "deaths": [1, 10]})))
    assert got == [(1, 3, "jumps", 1000), (1, 5, "deaths", 10)]


def test_interests(spark):
    rows = [(1, 0, "ask", "a", None), (1, 1, "ask", "b", None), (1, 2, "answer", "b", None), (1, 3, "thanks", None, None), (1, 4, "wrong", None, None), (1, 5, "wrong", None, None), (1, 302, "thanks", None, None), (1, 303, "ask", None, None)]
    got = [r[2] for r in sorted(told(folds.fold_batch(events(spark, rows), "user_id", folds.interests())), key=lambda r: r[1])]
    assert got == ["a:1", "b:1 a:1", "b:2 a:1", "b:1 a:1", "a:1"]


FOLDS = {
    "visits": folds.visits(), "throttle": folds.throttle({"ask": 400_000, "thanks": 60_000}, ("thanks",)), "milestones": folds.milestones({w: [10, 50, 90] for w in "abc"}), "interests": folds.interests(cap=4),
}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_stream_is_the_batch(rocks, tmp_path, name):
    r = random.Random(11)
    rows = [(r.randrange(4), r.randrange(6000), r.choice(["ask", "answer", "ask_back", "thanks", "wrong"]), r.choice(["a", "b", "c", None]), r.randrange(100)) for _ in range(160)]
    df = events(rocks, rows)
    parts = [df.where(F.unix_timestamp("ts") - int(BEGIN.timestamp()) < 2000), df.where((F.unix_timestamp("ts") - int(BEGIN.timestamp())).between(2000, 3999)), df.where(F.unix_timestamp("ts") - int(BEGIN.timestamp()) >= 4000)]
    # within a part events arrive in any order; two last ones move the watermark past everything that people keep
    ends = [events(rocks, [(99, 10**4, "talk", None, None)]), events(rocks, [(99, 10**7, "talk", None, None)])]
    for i, part in enumerate([*parts, *ends]):
        part.coalesce(1).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = folds.fold_stream(rocks.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id", FOLDS[name])
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert query.exception() is None
    got = rocks.read.parquet(str(tmp_path / "out")).where("user_id <> 99")
    assert told(got) == told(folds.fold_batch(df, "user_id", FOLDS[name])) and got.count() > 3
    kept = {r["key"]["user_id"] for r in rocks.read.format("statestore").option("stateVarName", "slots").load(str(tmp_path / "state")).select("key").collect()}
    assert kept <= {99} if FOLDS[name].life is not None else kept >= {0, 1, 2, 3}


def test_learned_interests_by_a_plain_loop(spark):
    """The registered query against interests kept as text between events."""
    import pandas as pd

    from conftest import DATA
    from quillspark.plans import QUERIES

    e = pd.read_parquet(f"{DATA}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    want, user, text, answered = set(), None, "", None
    for r in e.itertuples():
        if r.user_id != user:
            user, text, answered = r.user_id, "", None
        at, topic = r.ts.value // 1000 // 60, f"topic {r.event_id % 3}"
        change = None
        if r.event_type == "view":
            change = (topic, 1)
        elif r.event_type == "click":
            answered = (at, topic)
        elif answered and at - answered[0] < 300_000_000:
            change = (answered[1], -1 if r.event_type == "error" else 1)
        if change:
            counts = {p.rsplit(":", 1)[0]: int(p.rsplit(":", 1)[1]) for p in text.split("|") if p}
            counts[change[0]] = max(0, counts.get(change[0], 0) + change[1])
            if max(counts.values()) > 20:
                counts = {k: v // 2 for k, v in counts.items()}
            top = sorted(((v, k) for k, v in counts.items() if v), reverse=True)[:3]
            text = "|".join(f"{k}:{v}" for v, k in top)
            want.add((r.user_id, r.event_id, text.replace("|", " ")))
    got = [(r["user_id"], r["event_id"], r["interests"]) for r in QUERIES["learned_interests"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want
