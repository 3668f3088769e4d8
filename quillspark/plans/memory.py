"""Queries over what is remembered of people: events in the roles of questions, answers and remarks, a minute of the table as a second."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.common import query, table
from quillspark.streaming import folds

#: Least milliseconds between two remarks of a kind; remarks in QUIET also wait for each other's silence.
PAUSES, QUIET = {"ask": 120_000, "answer": 300_000, "ask_back": 60_000}, ("ask_back",)


def remembered(spark: SparkSession, sf_dir: str, talk: str = "talk") -> DataFrame:
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    kinds = F.when(kind == "view", "ask").when(kind == "click", "answer").when(kind == "error", "ask_back" if talk == "talk" else "wrong").otherwise(talk)
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60))
    return e.select("user_id", at.alias("ts"), F.col("event_id").alias("tie"), kinds.alias("kind"), F.concat(F.lit("topic "), (F.col("event_id") % 3).cast("string")).alias("what"), F.lit(None).cast("long").alias("n"))


_REMEMBERED = """e AS (SELECT user_id, event_id AS tie, epoch_us(ts) // 60 AS us, 'topic ' || event_id % 3 AS what,
  CASE event_type WHEN 'view' THEN 'ask' WHEN 'click' THEN 'answer' WHEN 'error' THEN 'ask_back' ELSE 'talk' END AS kind FROM events)"""
_BEFORE = "last_value(CASE WHEN kind = '{k}' THEN {v} END IGNORE NULLS) OVER w AS {k}_{v}"


@query(
    f"""WITH {_REMEMBERED}, b AS (SELECT *, {', '.join(_BEFORE.format(k=k, v=v) for k, v in (('ask', 'us'), ('ask', 'what'), ('answer', 'us'), ('answer', 'what'), ('ask_back', 'us')))}, lag(us) OVER (PARTITION BY user_id ORDER BY us, tie) AS seen
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, tie AS event_id, coalesce(kind = 'ask' AND what = ask_what AND us - ask_us < 600000000, false) AS is_repeat, CASE WHEN us - ask_us < 300000000 THEN ask_what END AS follows,
CASE WHEN us - answer_us < 300000000 THEN answer_what END AS thanked, coalesce(us - ask_back_us < 300000000, false) AS awaited, CASE WHEN us - ask_us < 1800000000 THEN ask_what END AS recalled,
coalesce(us - seen BETWEEN 10800000000 AND 2592000000000, false) AS back FROM b"""
)
def visit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each message: a question again, what it may follow up, thank for, reply to or recall, and whether the person is back."""
    return folds.visits_batch(remembered(spark, sf_dir), "user_id").withColumnRenamed("tie", "event_id").drop("ts")


_PAUSE = "(CASE e.kind " + " ".join(f"WHEN '{k}' THEN {v * 1000}" for k, v in PAUSES.items()) + " ELSE 0 END)"


@query(
    f"""WITH RECURSIVE {_REMEMBERED}, s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY us, tie) AS nth FROM e),
r AS (SELECT user_id, kind, nth, tie, us AS last, true AS passes FROM s WHERE nth = 1 UNION ALL
  SELECT e.user_id, e.kind, e.nth, e.tie, CASE WHEN e.us - r.last >= {_PAUSE} OR e.kind = 'ask_back' THEN e.us ELSE r.last END, e.us - r.last >= {_PAUSE}
  FROM r JOIN s e ON e.user_id = r.user_id AND e.kind = r.kind AND e.nth = r.nth + 1)
SELECT user_id, tie AS event_id, kind FROM r WHERE passes"""
)
def throttled_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remarks that may be made: each kind has its own pause."""
    out = folds.fold_batch(remembered(spark, sf_dir), "user_id", folds.throttle(PAUSES, QUIET))
    return out.select("user_id", F.col("tie").alias("event_id"), "kind")


@query()
def learned_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's interests after each change: questions, thanks and "that's not it" about the last answer's project. A fold with halving: no SQL."""
    out = folds.fold_batch(remembered(spark, sf_dir, "thanks"), "user_id", folds.interests(cap=20))
    return out.select("user_id", F.col("tie").alias("event_id"), "interests")
