import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import wordpiece, words as W
from quillspark.operators import records as R
from quillspark.sources import snapshots
from quillspark.streaming import stateful


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_words(spark):
    x = F.col("x")
    assert values(spark, W.project_name(x), [("home/a",), ("eden_world/b",), ("",), (None,)]) == ["Wiki", "Eden World", "", None]
    assert values(spark, W.line_start(x), [("Ooh, yes",), ("  Oh!",), ("123",), ("",), (None,)]) == ["oh", "oh", "", "", None]
    assert values(spark, W.topic_words(x), [("Endermen, foxes men's glass",), ("",)]) == [["enderman", "foxe", "men", "s", "glass"], []]
    assert values(spark, W.matches_key(x, ["*_x", "a*", "k"]), [("b_x",), ("ab",), ("k",), ("kk",), (None,)])[:4] == [True, True, True, False]
    assert values(spark, W.matches_key(x, []), [("a",)]) == [False]
    assert values(spark, W.is_article(x, F.lit("Drops")), [("Fox",), ("File:Fox",), ("Fox (disambiguation)",), (None,)]) == [True, False, False, True]
    assert values(spark, W.is_article(F.lit("Fox"), x), [("See also",), (" TRIVIA ",), ("Trivia night",)]) == [False, False, True]
    assert values(spark, W.keywords(x, {"pls": "please"}, ["the"]), [("the fox in minecraft pls",), ("",)]) == ["fox in please", ""]
    pairs = [("make fun of KaTTer, now", "katter"), ("Old  Man River", "old man"), ("x", "gone"), ("x", "")]
    assert values(spark, W.original_case(F.col("x"), F.col("y")), pairs, "x string, y string") == ["KaTTer", "Old  Man", "gone", ""]
    near = [("cobble", "cobblestone"), ("cob", "cobblestone"), ("ston", "stone"), ("stnoe", "stone"), ("spruse", "spruce"), ("andisite", "andesite"), ("abcd", "abcdefg"), ("abxd", "abcdefg")]
    assert values(spark, W.close(F.col("x"), F.col("y")), near, "x string, y string") == [True, False, True, False, True, True, True, False]


def test_pieces(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = ["[UNK]", "un", "##aff", "##able", "a", "##b", "##a", "b", ",", "fox", "##es"]
    library = Tokenizer(models.WordPiece({v: i for i, v in enumerate(vocabulary)}, unk_token="[UNK]"))
    library.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    texts = ["unaffable foxes, ab", "a_b  zz", "", "a" * 100 + " " + "a" * 101, "baab,abba"]
    got = values(spark, wordpiece.pieces(F.col("x"), set(vocabulary)), [(t,) for t in texts])
    assert got == [library.encode(t).tokens for t in texts]
    assert values(spark, wordpiece.pieces(F.col("x"), {"a"}, 3), [("a a a a",), (None,)]) == [["a", "a", "a"], []]


def test_steps_and_ideas(spark):
    steps = spark.createDataFrame([(1, 0, False), (2, 1, True), (3, 1, False), (4, 1, True), (5, 3, False)], "step long, parent long, hidden boolean")
    progress = spark.createDataFrame([(7, 0, True), (7, 1, True), (7, 2, False), (8, 0, False), (None, 0, True)], "player long, step long, done boolean")
    got = sorted((r["player"] or 0, r["step"]) for r in R.visible_steps(progress, steps).collect())
    assert got == [(0, 1), (7, 2), (7, 3)]  # 4 is hidden and not begun, 1 is done, 8 has done nothing
    done = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b"), (3, "zzz")], "p long, what string")
    ideas = [("first", None, "a"), ("second", "a", None), ("third", "b", "a"), ("fourth", None, None)]
    got = sorted((r["p"], r["nth"], r["idea"]) for r in R.progress_ideas(done, ["p"], "what", ideas).collect())
    assert got == [(1, 0, "second"), (1, 1, "fourth"), (2, 0, "first"), (2, 1, "fourth"), (3, 0, "first"), (3, 1, "third")]


def test_people_and_words(spark):
    names = spark.createDataFrame([("MrNox",), ("nox",), ("Noxious",), ("Ann",), (None,), ("Joanna",)], "name string")
    asked = spark.createDataFrame([("NOX",), ("nn",), ("ann",), ("xio",), ("zzz",), (None,), ("",), ("ann",)], "asked string")
    got = sorted((r["asked"], r["name"]) for r in R.people_named(asked, names).collect())
    assert got == [("NOX", "nox"), ("ann", "Ann"), ("xio", "Noxious")]
    part = spark.createDataFrame([("oann",), ("nox",)], "asked string")
    assert [(r["asked"], r["name"]) for r in R.people_named(part, names.where("name <> 'nox'")).orderBy("asked", "name").collect()] == [("nox", "MrNox"), ("nox", "Noxious"), ("oann", "Joanna")]
    known = spark.createDataFrame([("thanks",), ("hello",), ("hallo",), ("hey",)], "word string")
    typed = spark.createDataFrame([("thnaks",), ("hxllo",), ("jello",), ("hy",), ("hez",), ("hello",), ("hello",)], "word string")
    got = {r["word"]: r["fixed"] for r in R.known_words(typed, known).collect()}
    assert got == {"thnaks": "thanks", "hxllo": "hallo", "jello": "jello", "hy": "hy", "hez": "hez", "hello": "hello"}


def test_recipes(spark):
    made = [{"result": "Torch × 4", "imageUrl": "/a.png", "type": "Crafting"}, {"name": "Stick", "imageUrl": "b.png"}, {"name": "Bow"}, {"name": "Bed", "imageUrl": "http://c/d.png"}, {"name": "Rug", "imageUrl": ""}]
    m = spark.createDataFrame([(1, json.dumps(made)), (2, "no list"), (3, None), (4, "[]")], "k long, j string")
    rows = R.recipe_rows(m, "k", "j", "https://x.org/y/z.json")
    got = sorted((r["name"], r["picture"], r["crafting"]) for r in rows.collect())
    assert got == [("Bed", "http://c/d.png", False), ("Stick", "https://x.org/y/b.png", False), ("Torch", "https://x.org/a.png", True)]
    wanted = spark.createDataFrame([("Torch",), ("Bow",)], "name string")
    assert {r["name"]: r["picture"] for r in R.with_pictures(wanted, rows).collect()} == {"Torch": "https://x.org/a.png", "Bow": None}
    lines = spark.createDataFrame([(1, "B", 1, 2), (1, "A", 2, 9), (1, "B", 3, 9), (2, "A", 1, 9)], "r long, i string, at int, size int")
    assert {r["r"]: (r["ingredients"], r["needs_table"]) for r in R.recipe_cards(lines, "r", "i", "at", F.col("size") > 4).collect()} == {1: ("2× B, 1× A", False), 2: ("1× A", True)}


def test_quiz(spark, tmp_path):
    data = [(1, 1, "q", 0), (2, 1, "a", 60), (3, 1, "a", 61), (4, 1, "q", 100), (5, 1, "a", 221), (6, 2, "a", 5), (7, 2, "q", 6), (8, 2, "q", 7), (9, 2, "a", 127), (10, 2, "other", 1)]
    e = spark.createDataFrame(data, "event_id long, user_id long, kind string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000))
    got = {r["event_id"]: r["open"] for r in R.quiz_answers(e, "user_id", ["ts", "event_id"], "ts", "kind", "q", "a", 120).collect()}
    assert got == {2: True, 3: False, 5: False, 6: False, 9: True}
    e.write.parquet(str(tmp_path / "in"))
    stream = lambda kind: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")).where(F.col("kind") == kind)
    out = stateful.quiz_stream(stream("q"), stream("a"))
    out.writeStream.format("memory").queryName("quiz").option("checkpointLocation", str(tmp_path / "quiz")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["answered_at"].timestamp() - 1_700_000_000 for r in spark.table("quiz").where("user_id = 1").collect()) == [60, 61]


def test_defaults_and_ticks(spark):
    own = spark.createDataFrame([(1, "a", 9.0), (2, "a", None), (2, "zzz", 1.0)], "u long, k string, v double")
    got = sorted((r["u"], r["k"], r["v"]) for r in R.with_defaults(own, "u", "k", "v", {"a": 1.0, "b": 2.0}).collect())
    assert got == [(1, "a", 9.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 2.0)]
    ticks = spark.createDataFrame([("x", 10.0), ("y", 45.0), ("z", 100.0), ("n", None), ("o", 0.0)], "w string, ms double")
    got = {r["w"]: (r["tps"], r["verdict"]) for r in R.tick_health(ticks, "w", "ms").collect()}
    assert got["x"] == (20.0, "smooth") and got["y"] == (20.0, "busy") and got["z"] == (10.0, "lagging") and got["o"] == (20.0, "smooth")


def test_snapshots(spark, tmp_path):
    data = [(1, "a/b", "T", "H", "über\n\"x\"  ", None), (2, None, "", None, "", "m")]
    s = spark.createDataFrame(data, snapshots.SECTION)
    snapshots.save(s, str(tmp_path / "s"))
    assert sorted(map(tuple, snapshots.load(spark, str(tmp_path / "s")).collect())) == sorted(data)
    broken = spark.createDataFrame([("{no",), ("",), ('{"section_id": 3}',)], "value string")
    assert [r["section_id"] for r in snapshots.rows(broken).collect()] == [3]
    (tmp_path / "p").mkdir()
    for name, text in (("a", '{"n":\n 1}'), ("b", "{broken"), ("c", "")):
        (tmp_path / "p" / f"{name}.json").write_text(text)
    assert [(r["n"], r["seen"] is not None) for r in snapshots.states(spark, f"{tmp_path}/p/*.json", "n long").collect()] == [(1, True)]


@pytest.mark.parametrize("make", [
    lambda e: R.people_named(e.select(F.col("s").alias("asked")), e.select(F.col("s").alias("name"))), lambda e: R.known_words(e.select(F.col("s").alias("word")), e.select(F.col("s").alias("word"))),
    lambda e: R.recipe_rows(e, "k", "s", "https://x.org/a"), lambda e: R.tick_health(e, "s", "v"), lambda e: R.with_defaults(e, "k", "s", "v", {"a": 1.0}), lambda e: snapshots.rows(snapshots.lines(e), "k long"),
])
def test_empty(spark, make):
    assert make(spark.createDataFrame([], "k long, s string, v double")).collect() == []


def test_labels_and_texts(spark):
    st = spark.createDataFrame([("keep_it", "1"), ("odds", "0.25"), ("odds", "x"), ("mode", "b"), ("none", None)], "key string, value string")
    keys = spark.createDataFrame([("odds", "Odds of it")], "key string, label string")
    values = spark.createDataFrame([("keep_it", "true", "Yes"), ("mode", "b", "Big"), ("mode", "b", "Vast")], "key string, value string, label string")
    got = {(r["key"], r["value"]): (r["label"], r["shown"]) for r in R.labelled(st, keys, values, spark.createDataFrame([("odds",)], "key string")).collect()}
    assert got == {("keep_it", "1"): ("Keep It", "Yes"), ("odds", "0.25"): ("Odds of it", "25%"), ("odds", "x"): ("Odds of it", "x"), ("mode", "b"): ("Mode", "Big"), ("none", None): ("None", "")}
    texts = spark.createDataFrame([(1, 'Turns upside down\n\n"Dinner", "Grum"\n"Bone"\nRainbow\n"jeb"'), (2, '"alone"'), (3, None), (4, "")], "k long, t string")
    got = sorted((r["k"], r["effect"], r["accepted"]) for r in R.accepted_texts(texts, "k", "t").collect())
    assert got == [(1, "Rainbow", "jeb"), (1, "Turns upside down", "Bone"), (1, "Turns upside down", "Dinner"), (1, "Turns upside down", "Grum"), (2, "", "alone")]


def test_names_shuffle_no_words_that_name_nothing(spark):
    """a question's rows meet the names before any exchange."""
    from pyspark.sql import functions as F

    from quillspark.operators import reports

    q = spark.createDataFrame([(1, "what do red rings cost"), (2, "nothing here")], "k long, t string")
    got = reports.longest_name(q, "k", "t", spark.createDataFrame([("ring",), ("red ring",)], "name string"))
    assert [tuple(r) for r in got.collect()] == [(1, "red ring")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [k#") == 1, "no distinct over all words"
