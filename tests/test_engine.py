import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from conftest import DATA
from quillspark.operators import answers, index as I, palette as P, reports, search as S, settings
from quillspark.plans import QUERIES, SQL, pages, reports as plan_reports
from quillspark.sources import html
from quillspark.streaming import stateful

PAGE = """<h1 id="top">Fox</h1><style>x</style><p>Red <b>fur</b>.</p><details><summary>more</summary><p>Secret den</p></details>
<h2 id="loot">Loot</h2><table><tr><th>Item</th><td>Odds</td></tr></table><ul><li>Berry<li>Egg</ul><a class="toc-anchor">#</a><img src="a.png" alt="fox"><h3>Empty</h3>"""


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_sections():
    got = html.split(PAGE, "Fox")
    assert [(s["heading"], s["anchor"], s["image"]) for s in got] == [("Fox", "top", "a.png"), ("Loot", "loot", "a.png")]
    assert got[0]["text"] == "Red fur.\n⟦ Secret den\n⟧" and got[1]["text"] == "Item | Odds\n• Berry• Egg"
    assert html.split(None, "x") == [] and html.split("", "x") == []


def sections(spark):
    data = [
        (1, "foxes/home", "Main", "Main", "Foxes live in snowy woods and eat berries.", ""), (2, "foxes/den", "Fox Den", "Where to Find", "Dens are found near trees. A den holds three foxes.", ""),
        (3, "foxes/changelog", "Changelog", "Changelog", "Fox dens were added. Fox fox fox den den.", ""), (4, "owls/nest", "Owl Nest", "Crafting", "Owls nest high.", ""), (5, "owls/empty", "Owl Food", "", "Your content here", ""),
    ]
    return spark.createDataFrame(data, "section_id long, path string, page_title string, heading string, text string, meta string")


def test_find(spark):
    ix = I.build(sections(spark), True)
    syn = spark.createDataFrame([("lair", "den")], "word string, synonym string")
    q = spark.createDataFrame([(1, "where is the fox den"), (2, "fox lair"), (3, "owl nset"), (4, "zzzz"), (5, "")], "qid long, query string")
    got = {(r["qid"], r["rank"]): r for r in S.find(ix, q, syn).collect()}
    assert got[1, 1]["section_id"] == 2 and got[1, 1]["title_match"]  # title, and a heading that answers "where"
    assert got[2, 1]["section_id"] == 2
    assert got[3, 1]["section_id"] == 4  # a swap is one edit
    assert not any(k[0] in (4, 5) for k in got)
    lines = {r["qid"]: r["answer"] for r in answers.answer_lines(q, S.find(ix, q, syn), sections(spark), ix.terms).collect()}
    assert lines[1] == "A den holds three foxes."  # it has both words; the heading fits either sentence


def test_guesses(spark):
    terms = spark.createDataFrame([("thanks", 5), ("thank", 9), ("enchantment", 2), ("enchanted", 3)], "term string, df long")
    unknown = spark.createDataFrame([("thnaks",), ("enchantmnet",), ("encha",), ("12345",)], "term string")
    assert {r["term"]: (r["guess"], r["dist"]) for r in S.typo_corrections(unknown, terms).collect()} == {"thnaks": ("thanks", 1), "enchantmnet": ("enchantment", 1)}
    assert {r["term"]: r["guess"] for r in S.prefix_matches(unknown, terms).collect()} == {"encha": "enchanted"}


def test_excerpts():
    text = "One fox ran. Two owls flew over the den.\nThe fox den is old. Nothing here."
    assert answers.window_excerpt(text, {"fox": "fox", "den": "den"}, 24) == "…the **den.** The **fox** **den**…"
    assert answers.lines_excerpt(text, {"fox": "fox", "den": "den"}, 40) == "The **fox** **den** is old. Nothing here."
    assert answers.lines_excerpt("", {"fox": "fox"}) == "" and answers.window_excerpt("", {"x": "x"}) == ""


def test_excerpts_of_whole_questions(spark, tmp_path):
    """A word that stands late in a long question is looked up and marked."""
    text = " ".join(f"filler{i}" for i in range(12))
    spark.createDataFrame([(1, text + " walrus")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, "The walrus sleeps."), (8, "Owls nest.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["qid"], r["section_id"], r["excerpt"]) for r in QUERIES["excerpts"](spark, str(tmp_path)).collect()]
    assert got == [(1, 7, "The **walrus** sleeps.")]


SETTINGS = [
    (0, "Gentle Nights", "Gentle Nights › Sleep Share", "sleep share players", "50"), (1, "Gentle Nights", "Gentle Nights › Phantom Chance", "phantom spawnchance", "0.2"),
    (2, "Keep Things", "Keep Things › Keep Inventory", "keep inventory", "true"), (3, "Keep Things", "Keep Things › Grave Duration (Minutes)", "grave duration", "30"),
    (4, "Market Day", "Market Day › Listing Cost", "listing cost", "5"), (5, "Market Day", "Market Day › Stall Radius", "stall radius", "12"), (6, "Game Rules", "PvP", "pvp", "false"),
    (7, "Game Rules", "Keep Exp", "keepExp", "true"), (8, "Game Rules", "Spawn Mobs", "doMobSpawning", "true"), (9, "Game Rules", "Spawn Wardens", "spawnWardens", "true"), (10, "Game Rules", "Spawn Radius", "spawnRadius", "10"),
]


def test_settings(spark):
    s = spark.createDataFrame(SETTINGS, "setting_id long, pack string, label string, key_words string, value string")
    asked = ["is pvp on", "how long do graves last", "market day settings", "phantom chance", "how far is the stall", "where do parrots live", "keep inventory", "keep xp", "spawn", "do I keep my xp when I fight other players", None, ""]
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    got = {}
    for r in settings.rank(s, q).collect():
        got.setdefault(r["qid"], {})[r["place"]] = r["label"]
    assert got[0][1] == "PvP" and got[1][1].endswith("Grave Duration (Minutes)") and len(got[2]) == 2 and got[4][1].endswith("Stall Radius") and 5 not in got and got[6][1].endswith("Keep Inventory")
    none = spark.createDataFrame([], "setting_id long, pack string, label string, key_words string, value string")
    assert settings.rank(none, spark.createDataFrame([(1, "is pvp on")], "qid long, query string")).isEmpty()
    # A rule is named by all of the question's words: "xp" stays beside "exp", and "spawn" fits three rules, so it names none.
    words = {"xp": "exp"}
    rules = {(r["qid"], r["setting_id"]) for r in settings.named_rules(s, q, words, [(r"\bfight (other )?players\b", "pvp")]).collect()}
    assert rules == {(0, 6)}
    first = {r["qid"]: r["label"] for r in settings.search(s, q, words).where("place = 1").collect()}
    assert first[0] == "PvP" and first[7] == "Keep Exp" and first[6].endswith("Keep Inventory")
    assert settings.named_rules(none, q, words).isEmpty() and settings.search(none, q, words).isEmpty()


def test_deep_settings(spark):
    rows_ = [(1, '{"a":{"b":{"c":{"d":{"e":5}}}},"list":[1,{"x":2}],"s":"text","n":null,"o":{}}'), (2, "{}"), (3, None), (4, '{"f":true}')]
    flat = reports.flatten_settings(spark.createDataFrame(rows_, "id long, j string"), "j", ["id"])
    assert rows(flat) == [("1", "a.b.c.d.e", "5"), ("1", "n", "null"), ("1", "s", "text"), ("4", "f", "true")]
    shown = reports.labelled_only(flat, ["id"], spark.createDataFrame([("s", "Some text")], "key string, label string"))
    assert sorted((r["id"], r["key"], r["label"]) for r in shown.collect()) == [(1, "s", "Some text"), (4, "f", None)]


def test_palette(spark):
    c = pages.catalog(spark, DATA).toPandas()
    base = c["name"][0]
    got = P.choose(c, base)
    lab = c.set_index("name")[["l", "a", "b"]]
    assert base in got and len(got) == len(set(got)) == P.SIZE and P.choose(c, "nothing") == []
    assert list(lab.loc[got, "l"]) == sorted(lab.loc[got, "l"])
    others = [n for n in got if n != base]
    assert all(c.set_index("name")["pick"][others])


def test_palette_of_all_parts(spark, tmp_path):
    """Every part is in the catalogue and gets a palette, whatever its key."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").where("p_partkey % 40 = 0")
    part.write.parquet(str(tmp_path / "part.parquet"))
    c = pages.catalog(spark, str(tmp_path)).toPandas()
    got = {}
    for r in pages.palette(spark, str(tmp_path)).orderBy("nth").collect():
        got.setdefault(r["request"], []).append(r["name"])
    assert len(c) == part.count() and part.where("p_partkey >= 500").count() and set(got) == set(c["name"])
    assert all(got[n] == P.choose(c, n) for n in c["name"])


def test_palette_work_follows_looks(spark):
    """Blocks that look alike are one to choose from and one to start with, and palettes stay those of the whole catalogue."""
    c = pages.catalog(spark, DATA).where("name like '%7' or name like '%8'")
    n = c.count()
    twice = c.unionByName(c.withColumn("name", F.concat("name", F.lit(" too"))))
    asked = twice.select(F.col("name").alias("base"), F.col("name").alias("request"))
    assert P.candidates(twice).count() == P.candidates(c).count() <= n
    assert P.starts(asked, twice, "request", "base").select("start").distinct().count() <= n
    whole, got = twice.toPandas(), {}
    for r in P.palettes(asked, twice, "request", "base").orderBy("nth").collect():
        got.setdefault(r["request"], []).append(r["name"])
    assert len(got) == 2 * n and all(got[n] == P.choose(whole, n) for n in whole["name"])


def test_missing_criteria_pairs_are_not_shuffled(spark, tmp_path):
    spark.range(1, 121).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 81).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    met = [(1, 1), (1, 1), (41, 81), (2, 1), (40, 120), (7, None)]
    spark.createDataFrame(met, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = plan_reports.missing_criteria(spark, str(tmp_path))
    want = sorted((s, p) for s in range(1, 81) for p in range(1, 121) if s % 40 == p % 40 and (s, p) not in met)
    assert sorted((r["s_suppkey"], r["p_partkey"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan  # all pairs and all lines would be dealt anew by their keys


def test_boxes_of_one_cell_are_many_tasks(spark):
    people = spark.range(200).select(F.col("id").alias("c"), F.lit(1).alias("g"), F.lit(3).alias("px"), F.lit(4).alias("pz")).coalesce(1)
    boxes = spark.range(30).select(F.col("id").alias("s"), F.lit(1).alias("h"), *[F.lit(v).alias(n) for n, v in (("x0", 0), ("x1", 9), ("z0", 0), ("z1", 9))])
    found = reports.in_boxes(people, boxes, ("g", "h"), 5)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and len(sizes) > 4 and max(sizes) < 3000


def test_cooldown(spark):
    e = spark.createDataFrame([(1, 1, 0), (1, 2, 3), (1, 3, 5), (1, 4, 9), (1, 5, 10), (2, 6, 1)], "user_id long, event_id long, at long")
    assert sorted(r["event_id"] for r in stateful.cooldown_batch(e, 5).collect()) == [1, 3, 5, 6]
    counts = {}
    for p in ["a"] * 51 + ["b", "c", "d"]:
        counts = stateful.learn(counts, p)
    assert counts == {"a": 25, "d": 1, "c": 1}


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:03"), (1, "2024-01-01 00:00:06"), (2, "2024-01-01 00:00:01")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, out in (("kept", stateful.cooldown_stream(stream, 5)), ("merged", stateful.merged_answers(stream))):
        out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["user_id"], str(r["ts"])[-2:]) for r in spark.table("kept").collect()) == [(1, "00"), (1, "06"), (2, "01")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    got = QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: "NULL" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    mine = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert mine == sorted(tuple(plain(r[i]) for i in order) for r in expected)
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sums_of_a_search_need_no_exchange(spark):
    """A question's postings are not dealt anew by question and section: they are many more than postings."""
    docs = spark.createDataFrame([(i, f"stone word{i % 7} bridge{i % 3}") for i in range(60)], "section_id long, text string")
    asked = spark.createDataFrame([(1, "stone bridge1"), (2, "word3")], "qid long, query string")
    found = S.plain_search(I.build(docs), asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(qid#\d+L?, section_id#", plan)
    assert {(r["qid"], r["section_id"]) for r in found.where("rank = 1").collect()} == {(1, 58), (2, 59)}
