"""Queries over names, words and players' records."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T, words as W
from quillspark.functions.wordpiece import pieces
from quillspark.operators import records as R
from quillspark.plans.common import SECTIONS_SQL, query, sections, table
from quillspark.sources import snapshots

IGNORED = ["*7", "Customer#00000001*", "Customer#000000002"]
IDEAS = [("look around", None, "view"), ("try a click", "view", "click"), ("buy something", "click", "purchase"), ("sign up", "purchase", "signup"), ("mend it", "error", None)]
DEFAULTS = {"view": 1.0, "click": 2.0, "purchase": 3.0, "signup": 4.0, "error": 5.0, "rating": 0.5}
SLANG = {"la": "the", "und": "and", "der": "the", "en": "in"}
CAPS = {"view": 70, "click": 10, "purchase": 15, "signup": 5, "error": 20}
_LOW = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_MEN = "CASE WHEN w LIKE '%men' AND len(w) > 4 THEN left(w, -3) || 'man' ELSE w END"
_NULL = lambda v: "NULL" if v is None else f"'{v}'"


@query(
    f"""WITH {SECTIONS_SQL}, s AS (SELECT *, string_split(path, '/')[1] AS first FROM sec)
SELECT CASE WHEN first = 'home' THEN 'Wiki' ELSE array_to_string(list_transform(regexp_extract_all(lower(translate(first, '_', ' ')), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') END AS project,
count(DISTINCT page_title) AS pages, count(*) AS sections FROM s GROUP BY ALL"""
)
def project_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by name, their distinct page titles and sections."""
    return sections(spark, sf_dir).groupBy(W.project_name(F.col("path")).alias("project")).agg(F.countDistinct("page_title").alias("pages"), F.count("*").alias("sections"))


@query("""SELECT page_id, url FROM pages WHERE url IS NOT NULL AND regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) = 'en'""")
def published_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an address in the language of the index."""
    return table(spark, sf_dir, "pages").where(F.col("url").isNotNull() & (F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1) == "en")).select("page_id", "url")


@query(
    """WITH w AS (SELECT conv_id, turn, string_split(lower(regexp_extract(text, '[A-Za-z]+')), '') AS cs FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(cs, lambda c, i: i = 1 OR c <> cs[i - 1]), ''), '') AS start FROM w"""
)
def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(W.line_start(F.col("text")), F.lit("")).alias("start"))


@query(
    f"""SELECT conv_id, turn, array_to_string(list_transform(list_transform({_LOW}, lambda w: {_MEN}),
lambda w: CASE WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END), ' ') AS topic FROM conversations"""
)
def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(W.topic_words(F.col("text")), " ").alias("topic"))


@query(
    rf"""WITH s AS (SELECT conv_id, turn, text, {_LOW}[2:4] AS ws FROM conversations)
SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN '' ELSE regexp_extract(text, '(?i)' || array_to_string(ws, '\W+')) END AS written FROM s"""
)
def original_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second to fourth word of a message as a subject, in the letters that it was written in."""
    subject = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 2, 3), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", W.original_case(F.col("text"), subject).alias("written"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, list_distinct({_LOW}) AS ws FROM conversations), p AS (SELECT *, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM w),
x AS (SELECT conv_id, turn, unnest(ws) AS t, before FROM p), y AS (SELECT conv_id, turn, t, unnest(before) AS b FROM x)
SELECT conv_id, turn, count(DISTINCT t) AS close_words FROM y WHERE t = b OR (len(t) >= 4 AND (starts_with(b, t) OR (abs(len(t) - len(b)) <= 2 AND levenshtein(t, b) <= CASE WHEN len(b) < 7 THEN 1 ELSE 2 END)))
GROUP BY ALL"""
)
def close_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of a message are close to one of the message before; messages with none are left out."""
    ws = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ws.alias("ws"))
    c = c.withColumn("before", F.lag("ws").over(Window.partitionBy("conv_id").orderBy("turn")))
    n = F.size(F.filter("ws", lambda t: F.exists("before", lambda b: W.close(t, b)))).cast("long")
    return c.where(F.col("before").isNotNull()).select("conv_id", "turn", n.alias("close_words")).where("close_words > 0")


@query(
    f"""WITH w AS (SELECT DISTINCT unnest({_LOW}) AS word FROM conversations), k AS (SELECT DISTINCT unnest({_LOW}) AS known FROM benchmark),
f AS (SELECT word, min(known) AS fixed FROM w JOIN k ON left(word, 1) = left(known, 1) AND abs(len(word) - len(known)) <= 1
  WHERE len(word) >= 3 AND len(known) >= 4 AND word NOT IN (SELECT known FROM k) AND damerau_levenshtein(word, known) <= 1 GROUP BY word)
SELECT word, coalesce(fixed, word) AS fixed FROM w LEFT JOIN f USING (word)"""
)
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations, mended by the words of the benchmark."""
    of = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    return R.known_words(of("conversations"), of("benchmark"))


@query("SELECT c_custkey, c_name, ends_with(c_name, '7') OR starts_with(c_name, 'Customer#00000001') OR c_name = 'Customer#000000002' AS ignored FROM customer")
def ignored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", W.matches_key(F.col("c_name"), IGNORED).alias("ignored"))


@query(
    """WITH a AS (SELECT lower(p_type) AS asked FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT left(p_name, 8) FROM part), n AS (SELECT DISTINCT p_name AS name FROM part),
e AS (SELECT asked, name FROM a JOIN n ON lower(asked) = lower(name))
SELECT * FROM e UNION ALL SELECT asked, name FROM a JOIN n ON contains(lower(name), lower(asked)) WHERE len(asked) >= 3 AND asked NOT IN (SELECT asked FROM e)"""
)
def people_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the role of people: kinds, single words and starts of names are asked for."""
    p = table(spark, sf_dir, "part")
    asked = p.select(F.explode(F.concat(F.array(F.lower("p_type"), F.substring("p_name", 1, 8)), F.split("p_name", " "))).alias("asked"))
    return R.people_named(asked, p.select(F.col("p_name").alias("name")))


@query(
    """WITH g AS (SELECT l_suppkey AS player, l_partkey AS step, sum(l_quantity) >= 60 AS done FROM lineitem GROUP BY ALL),
st AS (SELECT p_partkey AS step, p_partkey // 10 AS parent, p_size % 5 = 0 AS hidden FROM part WHERE p_partkey > 0)
SELECT d.player, st.step FROM g AS d JOIN st ON st.parent = d.step LEFT JOIN g AS o ON o.player = d.player AND o.step = st.step
WHERE d.done AND NOT coalesce(o.done, false) AND (NOT st.hidden OR o.step IS NOT NULL)"""
)
def visible_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as players, parts as a tree of steps by tens."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("player"), F.col("l_partkey").alias("step")).agg((F.sum("l_quantity") >= 60).alias("done"))
    steps = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("step"), F.expr("p_partkey div 10").alias("parent"), (F.col("p_size") % 5 == 0).alias("hidden"))
    return R.visible_steps(g, steps)


@query(
    f"""WITH i AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{i}', {_NULL(a)}, {_NULL(u)})" for n, (i, a, u) in enumerate(IDEAS))}) AS t(n, idea, after, unless)),
d AS (SELECT user_id, hour(ts) AS hour, list(DISTINCT event_type) AS done FROM events GROUP BY ALL)
SELECT user_id, hour, row_number() OVER (PARTITION BY user_id, hour ORDER BY n) - 1 AS nth, idea FROM d CROSS JOIN i
WHERE (after IS NULL OR list_contains(done, after)) AND (unless IS NULL OR NOT list_contains(done, unless)) QUALIFY nth < 2"""
)
def progress_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do next, for each user and hour of the day."""
    e = table(spark, sf_dir, "events").select("user_id", F.hour("ts").cast("long").alias("hour"), "event_type")
    return R.progress_ideas(e, ["user_id", "hour"], "event_type", IDEAS)


@query(
    """WITH k AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS place, bool_and(l_quantity > 10) AS big FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(n || '× ' || l_returnflag, ', ' ORDER BY place, l_returnflag) AS ingredients, bool_and(big) AS needs_table FROM k GROUP BY l_orderkey"""
)
def recipe_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recipes: their lines by flag, and whether all of them are large."""
    return R.recipe_cards(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", F.col("l_quantity") > 10)


@query("SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_linenumber, l_partkey) AS place FROM lineitem")
def new_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
    return R.new_first(l, "l_orderkey", F.col("l_returnflag") == "R", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_partkey", "place")


@query("SELECT p_type, p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2")
def two_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two parts of a family; the limit is applied before the shuffle too."""
    nth = F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf_dir, "part").withColumn("nth", nth).where("nth <= 2").select("p_type", "p_brand", "p_partkey")


@query(
    f"""WITH d AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in DEFAULTS.items())}) AS t(event_type, other)),
o AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, event_type, coalesce(value, other) AS value FROM u CROSS JOIN d LEFT JOIN o USING (user_id, event_type)"""
)
def settings_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value that a user gave a setting, else its default."""
    own = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))
    return R.with_defaults(own, "user_id", "event_type", "value", DEFAULTS)


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ALL), e AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT c_custkey, c_name, coalesce(o.n, 0) AS orders, round(coalesce(total, 0), 2) AS spent, e.n IS NOT NULL AS met, coalesce(e.n, 0) AS talks
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey"""
)
def player_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with their statistics and, if they have talked, how often."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("said"))
    out = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").join(e, "c_custkey", "left")
    zero = lambda c, d: F.coalesce(c, F.lit(d))
    return out.select("c_custkey", "c_name", zero("n", 0).alias("orders"), F.round(zero("total", 0.0), 2).alias("spent"), F.col("said").isNotNull().alias("met"), zero("said", 0).alias("talks"))


@query(
    """WITH a AS (SELECT hour(ts) AS hour, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL)
SELECT hour, n, round(m, 4) AS mspt, round(CASE WHEN m > 0 THEN least(20.0::DOUBLE, 1000.0::DOUBLE / m) ELSE 20.0::DOUBLE END, 1) AS tps,
CASE WHEN m < 40 THEN 'smooth' WHEN m < 50 THEN 'busy' ELSE 'lagging' END AS verdict FROM a"""
)
def tick_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tick_health(table(spark, sf_dir, "events").select(F.hour("ts").cast("long").alias("hour"), "value"), "hour", "value")


@query(
    f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in CAPS.items())}) AS t(event_type, cap)), g AS (SELECT hour(ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT hour, event_type, n, cap::BIGINT AS cap, n >= cap AS "full" FROM g JOIN c USING (event_type)"""
)
def counts_at_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each kind there are in an hour, and whether its cap is reached."""
    caps = F.create_map(*(F.lit(x) for k, v in CAPS.items() for x in (k, v)))
    g = table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    g = g.withColumn("cap", F.try_element_at(caps, "event_type").cast("long")).where("cap IS NOT NULL")
    return g.select("hour", "event_type", "n", "cap", (F.col("n") >= F.col("cap")).alias("full"))


@query(
    """WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT l_orderkey, l_suppkey, o_custkey = l_suppkey OR o_orderstatus = 'F' OR s_nationkey = c_nationkey OR s_acctbal > 9000 AS readable
FROM x JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey"""
)
def readable_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether someone may see a place: their own, public, of someone who trusts them (here: of their nation), or as an admin."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    out = x.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    out = out.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    sees = (F.col("o_custkey") == F.col("l_suppkey")) | (F.col("o_orderstatus") == "F") | (F.col("s_nationkey") == F.col("c_nationkey")) | (F.col("s_acctbal") > 9000)
    return out.select("l_orderkey", "l_suppkey", sees.alias("readable"))


_SKIP = W.SKIP_TITLES.replace("'", "''")


@query(
    f"""WITH {SECTIONS_SQL}, x AS (SELECT section_id, CASE section_id % 7 WHEN 0 THEN 'File:' || page_title WHEN 1 THEN page_title || ' Edition' ELSE page_title END AS title,
CASE section_id % 5 WHEN 0 THEN 'See also' ELSE heading END AS heading FROM sec)
SELECT section_id, title, heading FROM x WHERE NOT regexp_matches(title, '{_SKIP}') AND lower(trim(heading)) NOT IN ({T.sql_list(W.SKIP_SECTIONS)})"""
)
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that are an article's; the tables hold no other kind, so some get a name of one."""
    nth, t = F.col("section_id"), F.col("page_title")
    title = F.when(nth % 7 == 0, F.concat(F.lit("File:"), t)).when(nth % 7 == 1, F.concat(t, F.lit(" Edition"))).otherwise(t)
    x = sections(spark, sf_dir).select("section_id", title.alias("title"), F.when(nth % 5 == 0, "See also").otherwise(F.col("heading")).alias("heading"))
    return x.where(W.is_article(F.col("title"), F.col("heading")))


@query(
    f"""SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_extract_all({T.sql_fold('text')}, '{T.WORD}'), lambda w: w NOT IN ({T.sql_list([*T.STOPWORDS, *W.CUE_WORDS])})),
lambda w: CASE w {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SLANG.items())} ELSE w END)[1:10], ' ') AS keywords FROM conversations"""
)
def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", W.keywords(F.col("text"), SLANG, T.STOPWORDS).alias("keywords"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, unnest({_LOW}) AS w, generate_subscripts({_LOW}, 1) AS pos FROM conversations), f AS (SELECT conv_id, turn, w, min(pos) AS pos FROM w GROUP BY ALL),
g AS (SELECT conv_id, turn, string_agg(w, ' ' ORDER BY pos) AS words FROM f GROUP BY ALL) SELECT conv_id, turn, coalesce(words, '') AS words FROM conversations LEFT JOIN g USING (conv_id, turn)"""
)
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a message once, where it came first."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(ws), " ").alias("words"))


@query(f"WITH {SECTIONS_SQL} SELECT section_id, path, page_title, heading, md5(text) AS digest, meta FROM sec")
def section_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as JSON lines and back."""
    back = snapshots.rows(snapshots.lines(sections(spark, sf_dir)))
    return back.select("section_id", "path", "page_title", "heading", F.md5("text").alias("digest"), "meta")


BASE = "https://example.org/data/recipes.json"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a list of one recipe, as JSON; a third have no picture, a third one beside the list."""
    k = F.col("p_partkey")
    url = F.when(k % 3 == 1, F.format_string("/pics/%d.png", k)).when(k % 3 == 2, F.format_string("%d.png", k))
    e = F.struct(F.concat_ws(" × ", "p_name", F.col("p_size").cast("string")).alias("result"), F.col("p_brand").alias("datapack"), F.when(k % 2 == 0, "Crafting Shaped").alias("type"), url.alias("imageUrl"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.to_json(F.array(e)).alias("json"))


_PICTURE = "'https://example.org/' || CASE p_partkey % 3 WHEN 1 THEN 'pics/' ELSE 'data/' END || p_partkey || '.png'"


@query(f"SELECT p_partkey, p_name AS name, p_brand AS datapack, {_PICTURE} AS picture, p_partkey % 2 = 0 AS crafting FROM part WHERE p_partkey % 3 <> 0")
def recipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recipe_rows(manifests(spark, sf_dir), "p_partkey", "json", BASE)


@query(f"SELECT p_name AS name, min({_PICTURE}) FILTER (p_partkey % 3 <> 0) AS picture FROM part GROUP BY p_name")
def recipe_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests(spark, sf_dir)
    return R.with_pictures(m.select(F.col("p_name").alias("name")).distinct(), R.recipe_rows(m, "p_partkey", "json", BASE))


@query(
    """SELECT l_partkey, l_returnflag AS label FROM lineitem JOIN part ON p_partkey = l_partkey
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag) = 1"""
)
def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions, lines as callers with a flag as their label."""
    return R.first_labels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), table(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"], "l_returnflag")


@query(
    """WITH e AS (SELECT *, lag(event_type) OVER w AS kind, lag(ts) OVER w AS before FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, coalesce(kind = 'view' AND epoch_us(ts) - epoch_us(before) <= 1800 * 1000000::BIGINT, false) AS open FROM e WHERE event_type = 'purchase'"""
)
def quiz_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as questions, purchases as answers, rounds of half an hour."""
    return R.quiz_answers(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "ts", "event_type", "view", "purchase", 1800).select("event_id", "user_id", "open")


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 2)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM s QUALIFY place <= 3"""
)
def best_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as questions, priorities as sources, prices as scores."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return R.best_of_sources(o, "o_custkey", "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 3).select("o_custkey", "o_orderkey", "place")


#: Pieces of one and two letters: a vocabulary by rule, whose pieces SQL can tell too.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAIRS = {m + x for m in ("", "##") for x in [*LETTERS, *(a + b for a in LETTERS for b in LETTERS)]}


@query(
    f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all({T.sql_fold('text')}, '[\\pL\\pM\\pN]+|[^\\pL\\pM\\pN\\s]')) AS w, generate_subscripts(regexp_extract_all({T.sql_fold('text')}, '[\\pL\\pM\\pN]+|[^\\pL\\pM\\pN\\s]'), 1) AS pos FROM benchmark),
p AS (SELECT item_id, pos, CASE WHEN regexp_full_match(w, '[a-z]{{1,100}}') THEN array_to_string(regexp_extract_all(w, '[a-z][a-z]?'), ' ##') ELSE '[UNK]' END AS ps FROM w),
j AS (SELECT item_id, string_split(string_agg(ps, ' ' ORDER BY pos), ' ')[1:512] AS ps FROM p GROUP BY item_id)
SELECT item_id, len(ps) AS n_pieces, md5(array_to_string(ps, ' ')) AS digest FROM j"""
)
def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "benchmark").select("item_id", pieces(T.fold(F.col("text")), PAIRS).alias("ps"))
    return got.select("item_id", F.size("ps").cast("long").alias("n_pieces"), F.md5(F.array_join("ps", " ")).alias("digest"))


@query(
    """WITH st AS (SELECT event_type AS pack, event_id AS id, 'key_' || (props->>'k')::BIGINT % 30 AS key, ((props->>'k')::BIGINT % 4)::VARCHAR AS value FROM events
  UNION ALL SELECT 'Game Rules', s_suppkey, 'rule_' || s_suppkey % 9, (s_nationkey % 2)::VARCHAR FROM supplier),
ky AS (SELECT 'key_' || n_nationkey AS key, n_name AS label FROM nation WHERE n_nationkey % 2 = 0), va AS (SELECT 'rule_' || r_regionkey AS key, r_name AS label FROM region),
pc AS (SELECT 'key_' || n_nationkey AS key FROM nation WHERE n_nationkey % 5 = 0)
SELECT pack, id, st.key, value, coalesce(ky.label, upper(st.key[1]) || replace(st.key[2:], '_', ' ')) AS label,
CASE WHEN value = '1' AND va.label IS NOT NULL THEN va.label WHEN pc.key IS NOT NULL THEN value::BIGINT * 100 || '%' ELSE value END AS shown
FROM st LEFT JOIN ky USING (key) LEFT JOIN va ON va.key = st.key LEFT JOIN pc ON pc.key = st.key"""
)
def labelled_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties and, as game rules, suppliers; nations label keys, regions label "true"."""
    k = F.get_json_object("props", "$.k").cast("long")
    number = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    st = table(spark, sf_dir, "events").select(F.col("event_type").alias("pack"), F.col("event_id").alias("id"), number("key_", k % 30).alias("key"), (k % 4).cast("string").alias("value"))
    rules = table(spark, sf_dir, "supplier").select(F.lit("Game Rules").alias("pack"), F.col("s_suppkey").alias("id"), number("rule_", F.col("s_suppkey") % 9).alias("key"), (F.col("s_nationkey") % 2).cast("string").alias("value"))
    n = table(spark, sf_dir, "nation").select(number("key_", F.col("n_nationkey")).alias("key"), "n_nationkey", F.col("n_name").alias("label"))
    v = table(spark, sf_dir, "region").select(number("rule_", F.col("r_regionkey")).alias("key"), F.lit("true").alias("value"), F.col("r_name").alias("label"))
    return R.labelled(st.unionByName(rules), n.where("n_nationkey % 2 = 0").drop("n_nationkey"), v, n.where("n_nationkey % 5 = 0").select("key"))


@query("SELECT p_partkey, p_type AS effect, unnest([p_name, p_brand]) AS accepted FROM part")
def accepted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sections: a kind, a blank line, and its name and brand in quotes."""
    text = F.concat(F.lit("Accepted Texts\n"), "p_type", F.lit('\n\n"'), "p_name", F.lit('"\n or "'), "p_brand", F.lit('"\nThe end'))
    return R.accepted_texts(table(spark, sf_dir, "part").withColumn("text", text), "p_partkey", "text")
