"""Queries over messages: classification, references, requests and short-term state."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import formats, messages as M, text as T
from quillspark.operators import classify
from quillspark.plans.common import MESSAGES_SQL, messages, query, table

SAYINGS = [
    "thaaanks bot lol", "how do I craft a waypoint hub?", "recipe for iron ingots", "oak boat recipe", "what about the boss one", "and in the nether?", "so it's the bosses?",
    "HELP I am stuck", "turtles", "where do I find him", "what dungeons are there", "how do I get there", "remind me in 10 minutes to check the furnace", "remind me to eat in 1h",
    "remind me after half an hour about it", "remind me in 2 seconds", "take me to 100 64 -200", "x 12 z: -7", "route to 300, -150 in the nether", "you're funny! tell me a joke",
    "pretty good, you?", "im bored gimme ideas", "can you tell me a joke please", "ok so where are trial chambers", "NO! Stop!", "thanks! how do I tame a cat",
]
PAGE = "Stone King"
_VALUES = ", ".join("({}, '{}')".format(i, s.replace("'", "''")) for i, s in enumerate(SAYINGS))
SAID_SQL = f"{MESSAGES_SQL}, s AS (SELECT conv_id, turn, text FROM m UNION ALL SELECT -1, * FROM (VALUES {_VALUES}))"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users wrote, and sayings that the rules are about."""
    extra = spark.createDataFrame([(-1, i, t) for i, t in enumerate(SAYINGS)], "conv_id long, turn long, text string")
    return messages(spark, sf_dir).unionByName(extra)


_N = T.sql_normalize("text")
_WORDS = f"string_split({_N}, ' ')"


def _any(of: list[str]) -> str:
    return f"list_has_any({_WORDS}, [{T.sql_list(of)}])"


def _starts(cues: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({_N} || ' ', '{c}')" for c in cues) + ")"


@query(f"WITH {SAID_SQL} SELECT conv_id, turn, {_N} AS normalized FROM s")
def normalized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", T.normalize(F.col("text")).alias("normalized"))


@query(
    f"""WITH {SAID_SQL}, w AS (SELECT *, {_WORDS} AS ws FROM s), tk AS ({T.sql_terms('s', 'conv_id, turn', 'text')}),
n AS (SELECT conv_id, turn, count(*) AS n FROM tk GROUP BY ALL)
SELECT conv_id, turn, contains(text, '?') OR {_any(M.INFO_WORDS)} AS seeks_info, {_starts(M.FOLLOW_UP_CUES)} AS follow_up, {_starts(M.CLARIFY_CUES)} AND NOT {_any(M.ASKING_WORDS)} AS clarifying,
coalesce(n, 0) > 0 AND (coalesce(n, 0) >= 2 OR contains(text, '?') OR coalesce(list_filter(ws, lambda x: x NOT IN ({T.sql_list(M.FILLER_WORDS)}))[1] IN ({T.sql_list(M.QUESTION_WORDS)}), false)) AS question
FROM w LEFT JOIN n USING (conv_id, turn)"""
)
def message_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return said(spark, sf_dir).select("conv_id", "turn", M.seeks_info(t).alias("seeks_info"), M.is_follow_up(t).alias("follow_up"), M.is_clarifying(t).alias("clarifying"), M.looks_like_question(t).alias("question"))


@query(
    f"""WITH {SAID_SQL}, w AS (SELECT *, len(regexp_extract_all(text, '{M.SMALL}')) AS l, len(regexp_extract_all(text, '{M.CAPITALS}')) AS k FROM s)
SELECT conv_id, turn, CASE WHEN (l >= 4 AND k >= 0.7 * l) OR contains(text, '!!') THEN 'excited' WHEN {_any(M.STRESS_WORDS)} THEN 'stressed'
WHEN {_N} = '' OR len({_WORDS}) <= 2 THEN 'terse' ELSE 'normal' END AS energy FROM w"""
)
def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", M.energy(F.col("text")).alias("energy"))


@query(
    rf"""WITH {SAID_SQL} SELECT conv_id, turn, regexp_replace(text, '\b(it|its|him|her|them|they|he|she)\b', '{PAGE}', 'i') AS resolved FROM s
WHERE NOT regexp_matches(text, '\bthere\b', 'i')"""
)
def resolve_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns; "there" needs a look behind that only Spark's expressions have, and is tested apart."""
    rows = said(spark, sf_dir).where(~F.col("text").rlike(r"(?i)\bthere\b"))
    return rows.select("conv_id", "turn", M.resolve_reference(F.col("text"), F.lit(PAGE)).alias("resolved"))


_ASK = r"^(?:how (?:do|can|would|should) (?:i|you|we|one) (?:craft|make)|how to (?:craft|make)|(?:whats|what is|show me|give me) the (?:crafting )?recipe (?:for|of)|(?:crafting )?recipe (?:for|of)|craft(?:ing)? recipe for) (?:an? |the |some )?(.+?)(?: in minecraft)?$"


@query(
    rf"""WITH {SAID_SQL}, n AS (SELECT *, {_N} AS n FROM s),
i AS (SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(n, '{_ASK}') THEN regexp_extract(n, '{_ASK}', 1) WHEN regexp_matches(n, '^(.+?) (?:crafting )?recipe$') THEN regexp_extract(n, '^(.+?) (?:crafting )?recipe$', 1) END, '^(?:an?|the|some) ', '')) AS item FROM n)
SELECT conv_id, turn, CASE WHEN item <> '' AND len(string_split(item, ' ')) <= 5 THEN item END AS item FROM i"""
)
def recipe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", M.recipe_item(F.col("text")).alias("item"))


_ROW = r"(?:^|[^\w.])(-?\d{1,8})(?:\s*,\s*|\s+)(-?\d{1,8})(?:(?:\s*,\s*|\s+)(-?\d{1,8}))?(?:[^\w.]|$)"
_NUMBERS = ", ".join(rf"regexp_extract_all(low, '\b{k}\s*[=:]?\s*(-?\d{{1,8}})\b', 1)[-1]::INT AS {k}" for k in "xyz")


@query(
    f"""WITH {SAID_SQL}, w AS (SELECT conv_id, turn, lower(text) AS low FROM s),
n AS (SELECT conv_id, turn, {_NUMBERS}, {', '.join(f"nullif(regexp_extract(low, '{_ROW}', {i}), '')::INT AS {v}" for i, v in enumerate('abc', 1))} FROM w)
SELECT conv_id, turn, x, y, z FROM n WHERE x IS NOT NULL AND z IS NOT NULL
UNION ALL SELECT conv_id, turn, a, CASE WHEN c IS NOT NULL THEN b END, coalesce(c, b) FROM n WHERE (x IS NULL OR z IS NULL) AND a IS NOT NULL"""
)
def message_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", M.coordinates(F.col("text")).alias("c")).where("c is not null").select("conv_id", "turn", "c.*")


_AMT = M._AMOUNT
_IN, _TO = M.REMIND_IN, M.REMIND_TO
_LOW = "regexp_replace(trim(lower(text)), '[!.]+$', '')"


@query(
    rf"""WITH {SAID_SQL}, l AS (SELECT conv_id, turn, {_LOW} AS low FROM s), p AS (SELECT *, regexp_matches(low, '{_IN}') AS one FROM l WHERE regexp_matches(low, '{_IN}') OR regexp_matches(low, '{_TO}')),
q AS (SELECT conv_id, turn, CASE WHEN one THEN regexp_extract(low, '{_IN}', 1) ELSE regexp_extract(low, '{_TO}', 2) END AS a, CASE WHEN one THEN regexp_extract(low, '{_IN}', 2) ELSE regexp_extract(low, '{_TO}', 3) END AS u,
  CASE WHEN one THEN regexp_extract(low, '{_IN}', 3) ELSE regexp_extract(low, '{_TO}', 1) END AS w FROM p),
r AS (SELECT conv_id, turn, floor(coalesce(CASE WHEN a IN ('a', 'an', 'one') THEN 1 WHEN a IN ('half a', 'half an') THEN 0.5 WHEN a = 'a couple of' THEN 2 WHEN a = 'a few' THEN 3 END::DOUBLE, try_cast(replace(a, ',', '.') AS DOUBLE))
  * CASE WHEN starts_with(u, 'h') THEN 3600 WHEN starts_with(u, 'm') THEN 60 ELSE 1 END + 0.5)::BIGINT AS seconds, regexp_replace(trim(w), '^(?:to|about|that|of) ', '') AS what FROM q)
SELECT * FROM r WHERE seconds BETWEEN 5 AND 86400"""
)
def parsed_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", M.reminder(F.col("text")).alias("r")).where("r is not null").select("conv_id", "turn", "r.*")


_SPLIT = r"string_split(regexp_replace(x, '([.!?])\s+([A-Z0-9\"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(
    rf"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
e AS (SELECT doc_id, line, {_SPLIT} AS ss FROM d) SELECT doc_id, line, len(ss) AS sentences, md5(array_to_string(ss, chr(2))) AS digest FROM e"""
)
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).withColumn("ss", M.sentences(F.col("x")))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.size("ss").cast("long").alias("sentences"), F.md5(F.array_join("ss", "\u0002").cast("binary")).alias("digest"))


_STRIPPED = "regexp_replace(regexp_replace({n}, '^(?:(?:" + "|".join(sorted(classify.STRIP_START, key=len, reverse=True)) + ") )+', ''), '(?: (?:" + "|".join(sorted(classify.STRIP_END, key=len, reverse=True)) + "))+$', '')"


def _runs(v: str, to: int) -> str:
    """Runs of three or more of a letter cut to ``to``, a letter at a time."""
    for c in "abcdefghijklmnopqrstuvwxyz":
        v = f"regexp_replace({v}, '{c}{{3,}}', '{c * to}', 'g')"
    return v


@query(f"WITH {SAID_SQL}, v AS (SELECT conv_id, turn, unnest([n, {_runs('n', 1)}, {_runs('n', 2)}]) AS x FROM (SELECT conv_id, turn, {_N} AS n FROM s)) SELECT DISTINCT conv_id, turn, {_STRIPPED.format(n='x')} AS variant FROM v")
def stretched_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = said(spark, sf_dir).select("conv_id", "turn", T.normalize(F.col("text")).alias("n"))
    out = plain.withColumn("variant", F.explode(M.stretched(F.col("n"))))
    return out.select("conv_id", "turn", M.strip_phrases(F.col("variant"), classify.STRIP_START, classify.STRIP_END).alias("variant")).distinct()


_RULES = ", ".join("({}, '{}', '{}')".format(i, p.replace("'", "''"), n) for i, (p, n) in enumerate(classify.PATTERNS))
_KEYS = ", ".join("({}, '{}', [{}], [{}])".format(i, n, T.sql_list(t), T.sql_list(sorted({*w, *" ".join(t).split()}))) for i, (n, t, w) in enumerate(classify.KEYWORDS))
CLASSIFY_SQL = f"""ru(rule, pattern, pool) AS (VALUES {_RULES}), ke(rule, pool, triggers, allowed) AS (VALUES {_KEYS}),
v AS (SELECT conv_id, turn, n, {_STRIPPED.format(n='n')} AS n2 FROM (SELECT conv_id, turn, {_N} AS n FROM s)),
v2 AS (SELECT conv_id, turn, 0 AS k, n AS x FROM v WHERE n <> '' UNION ALL SELECT conv_id, turn, 1, n2 FROM v WHERE n2 <> '' AND n2 <> n),
hits AS (SELECT conv_id, turn, 0 AS tier, k, rule, pool FROM v2 JOIN ru ON regexp_full_match(x, pattern)
  UNION ALL SELECT conv_id, turn, 1, k, rule, pool FROM v2 JOIN ke ON len(list_filter(triggers, lambda t: contains(' ' || x || ' ', ' ' || t || ' '))) > 0 AND list_has_all(allowed, string_split(x, ' '))),
best AS (SELECT conv_id, turn, pool FROM hits QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY tier, k, rule) = 1)"""


@query(f"WITH {SAID_SQL}, {CLASSIFY_SQL} SELECT conv_id, turn, best.pool FROM s LEFT JOIN best USING (conv_id, turn)")
def classify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = said(spark, sf_dir)
    return classify.small_talk(rows.withColumn("id", F.struct("conv_id", "turn")), "id", "text", classify.rules(spark), classify.keywords(spark)).select("id.*", "pool")


@query(
    f"""WITH {SAID_SQL}, {CLASSIFY_SQL.replace('FROM s)', "FROM pre)").replace('v AS (', "pre AS (SELECT conv_id, turn * 1000 + k AS turn, array_to_string(ws[1:k], ' ') AS text FROM (SELECT *, string_split(trim(text), ' ') AS ws FROM s WHERE conv_id = -1), range(1, 8) r(k) WHERE k < len(ws)), v AS (", 1)},
p AS (SELECT conv_id, turn // 1000 AS turn, turn % 1000 AS k, pool FROM best), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY k DESC) = 1)
SELECT f.conv_id, f.turn, pool, array_to_string(string_split(trim(text), ' ')[k + 1:], ' ') AS rest FROM f JOIN s USING (conv_id, turn)"""
)
def split_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small talk that a question starts with: the longest prefix (up to seven words) that is one."""
    rows = said(spark, sf_dir).where("conv_id = -1").withColumn("id", F.struct("conv_id", "turn"))
    return classify.split_prefix(rows, "id", "text", classify.rules(spark), classify.keywords(spark)).select("id.*", "pool", "rest")


@query(
    """WITH m AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, coalesce(lag(turn) OVER w, -1) AS previous, coalesce(len(text) > len(lag(text) OVER w), false) AS longer FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def follow_up_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the one before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages(spark, sf_dir).select("conv_id", "turn", F.coalesce(F.lag("turn").over(w), F.lit(-1)).alias("previous"), F.coalesce(F.length("text") > F.lag(F.length("text")).over(w), F.lit(False)).alias("longer"))


@query(
    """SELECT user_id, event_id, event_type, ts - lag(ts) OVER w < INTERVAL 600 SECOND AS is_repeat FROM events
WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id) QUALIFY is_repeat IS NOT NULL"""
)
def repeat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same thing asked again by the same person within ten minutes."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    return e.withColumn("is_repeat", gap < 600_000_000).where("is_repeat is not null").select("user_id", "event_id", "event_type", "is_repeat")


@query("SELECT event_id, user_id, CASE WHEN h BETWEEN 5 AND 11 THEN 'greeting_morning' WHEN h BETWEEN 12 AND 17 THEN 'greeting_afternoon' WHEN h BETWEEN 18 AND 22 THEN 'greeting_evening' ELSE 'greeting_night' END AS pool FROM (SELECT *, hour(ts) AS h FROM events)")
def greeting_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", formats.greeting(F.hour("ts")).alias("pool"))


@query(
    """WITH g AS (SELECT user_id, event_id, ts, date_diff('microsecond', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, gap // 60000000 AS away_minutes FROM g WHERE gap BETWEEN 3 * 3600000000 AND 30 * 86400000000"""
)
def welcome_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who were away for three hours to thirty days."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    e = table(spark, sf_dir, "events").withColumn("gap", gap).where(F.col("gap").between(3 * 3600 * 10**6, 30 * 86400 * 10**6))
    return e.select("user_id", "event_id", F.floor(F.col("gap") / 60_000_000).cast("long").alias("away_minutes"))
