"""Stored indexes, live search, vectors, rules and routing on small cases, against plain versions and by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import distance, text as T
from quillspark.operators import classify, index as I, live, route as R, rules, search as S, store, vectors as V

SECTIONS = [
    (1, "foxes/home", "Main", "Main", "Foxes live in snowy woods and eat berries.", ""), (2, "foxes/red/den", "Fox Den", "Where to Find", "Dens are found near trees. A den holds three foxes.", ""),
    (3, "foxes/red/tail", "Fox Tail", "Colors", "Tails are red or white. Every fox tail is bushy.", ""), (4, "foxes/red/overview", "Fox Overview", "Overview", "All red foxes at a glance.", ""),
    (5, "owls/nest", "Owl Nest", "Crafting", "Owls nest high in old trees.", ""), (6, "owls/nest", "Owl Nest", "Loot", "A nest holds feathers and an egg.", ""), (7, "owls/food", "Owl Food", "", "Your content here", ""),
    (8, "gems/ruby", "Ruby", "Obtaining", "Rubies are mined deep below the woods.", ""), (9, "gems/ruby_block", "Block of Ruby", "Crafting", "Nine rubies craft a block.", ""),
]
COLUMNS = "section_id long, path string, page_title string, heading string, text string, meta string"


@pytest.fixture(scope="module")
def sections(spark):
    return spark.createDataFrame(SECTIONS, COLUMNS)


@pytest.fixture(scope="module")
def no_synonyms(spark):
    return spark.createDataFrame([("lair", "den")], "word string, synonym string")


def plain(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)


# The stored index


def found(index, spark, text, no_synonyms):
    q = spark.createDataFrame([(1, text)], "qid long, query string")
    return [r["section_id"] for r in sorted(S.find(index, q, no_synonyms).collect(), key=lambda r: r["rank"])]


def test_stored_index_is_the_plain_one(spark, sections, no_synonyms, tmp_path):
    stored = store.StoredIndex(spark, f"file://{tmp_path}/index", 3)
    with pytest.raises(FileNotFoundError):
        stored.open()
    stored.build(sections)
    a, b = I.build(sections, True), stored.open()
    for name, columns in {"postings": ["section_id", "term", "tf"], "terms": ["term", "df", "idf"], "bigrams": ["section_id", "pair", "tf"], "lengths": ["section_id", "length"]}.items():
        assert plain(getattr(a, name), *columns) == plain(getattr(b, name), *columns), name
    q = spark.createDataFrame([(1, "where is the fox den"), (2, "owl nset feathers"), (3, "zzzz"), (4, None), (5, "which fox are there")], "qid long, query string")
    assert plain(S.find(a, q, no_synonyms), "qid", "rank", "section_id", "score") == plain(S.find(b, q, no_synonyms), "qid", "rank", "section_id", "score")


def test_upsert_equals_a_rebuild(spark, sections, no_synonyms, tmp_path):
    stored, fresh = (store.StoredIndex(spark, f"file://{tmp_path}/{n}", 3) for n in "ab")
    stored.build(sections)
    changed = spark.createDataFrame([(5, "owls/nest", "Owl Nest", "Crafting", "Owls nest in caves now.", ""), (20, "bats/cave", "Bat Cave", "", "Bats sleep in caves.", "")], COLUMNS)
    stored.upsert(changed, spark.createDataFrame([(8,)], "section_id long"))
    fresh.build(sections.where("section_id not in (5, 8)").unionByName(changed))
    a, b = stored.open(), fresh.open()
    for name, columns in {"postings": ["section_id", "term", "tf"], "terms": ["term", "df", "idf"], "pairs": ["pair", "df"], "lengths": ["section_id", "length"], "corpus": ["n", "avg_len"], "features": ["section_id", "title_terms"]}.items():
        assert plain(getattr(a, name), *columns) == plain(getattr(b, name), *columns), name
    assert found(a, spark, "bat caves", no_synonyms)[0] == 20


def test_failed_build_changes_nothing(spark, sections, no_synonyms, tmp_path):
    stored = store.StoredIndex(spark, f"file://{tmp_path}/index", 2)
    stored.build(sections)
    live_, before = stored.manifest(), found(stored.open(), spark, "fox den", no_synonyms)
    broken = sections.withColumn("text", F.raise_error(F.lit("broken page")).cast("string"))
    for call in (stored.build, stored.upsert):
        with pytest.raises(Exception, match="broken page"):
            call(broken)
        assert stored.manifest() == live_ and found(stored.open(), spark, "fox den", no_synonyms) == before
    left = {p.name for p in (tmp_path / "index").iterdir() if not p.name.startswith(".")}
    assert left == {live_["version"], store.MANIFEST}, "what a failed build wrote is gone"
    old = stored.open()
    stored.build(sections)
    assert found(old, spark, "fox den", no_synonyms) == before, "the version before stays for searches that read it"


def test_index_follows_a_stream(spark, sections, no_synonyms, tmp_path):
    stored = store.StoredIndex(spark, f"file://{tmp_path}/index", 2)
    source = f"{tmp_path}/in"
    sections.where("section_id < 5").withColumn("at", F.lit(1)).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(sections.withColumn("at", F.lit(1)).schema).parquet(source)
        stored.follow(stream, "pages", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)

    run()
    first = stored.manifest()
    twice = [(2, "foxes/red/den", "Fox Den", "", "An old text.", "", 2), (2, "foxes/red/den", "Fox Den", "", "Lanterns light the den.", "", 3)]
    spark.createDataFrame(twice, COLUMNS + ", at int").coalesce(1).write.mode("append").parquet(source)
    run()
    assert stored.manifest()["streams"]["pages"] == first["streams"]["pages"] + 1
    terms = {r["term"] for r in stored.open().postings.where("section_id = 2").collect()}
    assert "lantern" in terms and "old" not in terms and "tree" not in terms, "of two rows of one section the later counts"
    version = stored.manifest()["version"]
    assert stored.upsert(sections, stream=("pages", 0)) == version, "a batch that is delivered again does nothing"


def test_generated_rows_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/quiz"
    rows = lambda *r: spark.createDataFrame(r, "q string, a string")
    store.replace_generated(spark, path, rows(("g1", "x")))
    hand = spark.read.parquet(path).unionByName(rows(("by hand", "y")).withColumn("generated", F.lit(None).cast("boolean")))
    store.kept(hand, "hand").write.mode("overwrite").parquet(path)
    store.replace_generated(spark, path, rows(("g2", "z"), ("g3", "z")))
    assert plain(spark.read.parquet(path), "q", "generated") == [("by hand", None), ("g2", True), ("g3", True)]


# Live search


def test_pools_have_statistics_of_their_own(spark, sections):
    pools = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 3), (2, 5)], "qid long, section_id long")
    mini = I.of_pools(sections, pools)
    for qid, ids in ((1, [2, 3]), (2, [3, 5])):
        alone = I.build(sections.where(F.col("section_id").isin(ids)), True)
        assert plain(mini.terms.where(F.col("qid") == qid), "term", "df", "idf") == plain(alone.terms, "term", "df", "idf")
        assert plain(mini.pairs.where(F.col("qid") == qid), "pair", "df", "idf") == plain(alone.pairs, "pair", "df", "idf")
        assert plain(mini.corpus.where(F.col("qid") == qid), "n", "avg_len") == plain(alone.corpus, "n", "avg_len")


def test_live_search_is_a_search_of_each_questions_pages(spark, sections, no_synonyms):
    pages = sections.groupBy("path").agg(F.min("section_id").alias("page_id"), F.min("page_title").alias("title")).select("page_id", "path", "title")
    pages = pages.unionByName(spark.createDataFrame([(90, "x/1", "Ruby Edition"), (91, "x/2", "File:Ruby"), (92, "x/3", "  ")], pages.schema))
    asked = [(1, "how do I craft a block of ruby", False), (2, "owl nest loot", False), (3, "rubby", True), (4, "feathers", False), (5, None, False), (6, "the owl", True), (7, "vanilla minecraft", False), (8, "foxx den", True)]
    q = spark.createDataFrame(asked, "qid long, query string, check boolean")
    got = {}
    for r in live.live_search(q, sections, pages).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r
    assert got[1][1]["section_id"] == 9 and got[1][1]["titled"] and got[2][1]["section_id"] == 6 and got[2][1]["titled"]
    assert got[3][1]["section_id"] == 8 and set(got[3]) == {1}, "a mistyped title is found on the second try, and named"
    assert 4 not in got and 5 not in got and 7 not in got, "no title fits"
    assert 6 not in got, "a page that isn't named doesn't count where it must be"
    assert 8 not in got, "words of three letters are not like others"
    # The same by one search each over the pages' own index.
    for qid, query in ((1, "craft block ruby"), (2, "owl nest loot")):
        one = spark.createDataFrame([(qid, query)], "qid long, query string")
        titles = live.title_candidates(one, live.articles(pages))
        mine = sections.join(titles.select("path"), "path", "left_semi").withColumn("vanilla", F.lit(True))
        order = [r["path"] for r in titles.orderBy("place").collect()]
        priors = spark.createDataFrame([(qid, p, (1.5, 0.75, 0.0)[i]) for i, p in enumerate(order)], "qid long, path string, prior double")
        hints = live._hints(one.withColumn("query", F.lit(asked[qid - 1][1])))
        want = S.find(I.build(mine, True), one, no_synonyms, limit=2, min_score=1.0, priors=priors, hints=hints)
        assert [(r["section_id"], r["score"]) for r in want.orderBy("rank").collect()] == [(r["section_id"], r["score"]) for _, r in sorted(got[qid].items())]


def most_joined(spark, since):
    """The most rows that a join made in the executions after the first ``since``, and the number of executions."""
    store_ = spark._jsparkSession.sharedState().statusStore()
    runs, most = store_.executionsList(), 0
    for i in range(since, runs.size()):
        number = runs.apply(i).executionId()
        of, at = {}, store_.executionMetrics(number).iterator()
        while at.hasNext():
            one = at.next()
            of[one._1()] = one._2()
        nodes = store_.planGraph(number).allNodes()
        for n in (nodes.apply(k) for k in range(nodes.size())):
            metrics = [n.metrics().apply(k) for k in range(n.metrics().size())]
            rows = [of.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows" and "Join" in n.name()]
            most = max([most, *(int(r.replace(",", "")) for r in rows if r)])
    return most, runs.size()


def test_titles_meet_questions_by_sets_of_words(spark):
    rng = np.random.default_rng(5)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnopqr"]
    titles = ["common " + words[i % 64] + ("" if i % 3 else " " + words[(7 * i) % 64]) for i in range(300)]
    titles += [" ".join(rng.choice(words[:20], n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 12) for _ in range(12)]
    pages = spark.createDataFrame([(i, f"p/{i}", t) for i, t in enumerate(titles)], "page_id long, path string, title string")
    asked = [(i, f"common {words[i % 64]} {words[(3 * i) % 64]}") for i in range(40)] + [(100 + i, " ".join(rng.choice(words[:24], n))) for i, n in enumerate([1, 2, 4, 8, 12, 16, 30])]
    asked += [(200, "common"), (201, "nothing here"), (202, "common common nothing")]
    q = spark.createDataFrame(asked, "qid long, query string")
    _, since = most_joined(spark, 0)
    got = live.title_candidates(q, pages).collect()
    most, _ = most_joined(spark, since)
    # By all titles of each word.
    scored = S.weighed(live.title_index(pages), S.query_terms(q).select("qid", "term")).groupBy("qid", "section_id").agg(F.round(F.sum("s"), 4).alias("score")).collect()
    want = {}
    for r in scored:
        want.setdefault(r["qid"], []).append((-r["score"], len(titles[r["section_id"]]), r["section_id"]))
    assert {(r["qid"], r["place"], r["page_id"]) for r in got} == {(k, n + 1, x[2]) for k, v in want.items() for n, x in enumerate(sorted(v)[:3])}
    assert all((r["path"], r["title"]) == (f"p/{r['page_id']}", titles[r["page_id"]]) for r in got)
    assert most < 42 * 300, "questions are not put beside all titles of a common word"


def test_live_search_reads_texts_once(spark, sections):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    pages = sections.groupBy("path").agg(F.min("section_id").alias("page_id"), F.min("page_title").alias("title")).select("page_id", "path", "title")
    q = spark.createDataFrame([(1, "how do I craft a block of rubby"), (2, "owl nest loot fox ruby")], "qid long, query string")
    assert live.live_search(q, sections.withColumn("text", counted("text")), pages).count()
    assert 0 < read.value <= sections.count()


@pytest.mark.parametrize("keys", [[], ["qid"]])
def test_guesses_of_a_corpus_are_those_of_its_words_alone(spark, keys):
    words = [("thanks", 4), ("thinks", 4), ("thank", 9), ("lantern", 1), ("lanterns", 2), ("lanternfish", 1), ("enchantment", 3), ("enchantments", 3), ("abcd", 1), ("12345", 7), ("obsidian", 1), ("obsidain", 1)]
    asked = ["thnaks", "thansk", "lanten", "lantrens", "enchatnmetn", "encha", "lant", "abdc", "12354", "obsdiain", "than", "zzzzz", "abc"]
    vocab = spark.createDataFrame([(1, w, n) for w, n in words] + ([(2, "thansks", 1), (2, "zzzz", 1)] if keys else []), "qid long, term string, df long")
    lost = spark.createDataFrame([(1, w) for w in asked] + ([(2, "thnaks"), (2, "encha"), (3, "lant")] if keys else []), "qid long, term string")

    def best(found):
        return min(found)[-1] if found else None

    long = [w for w in words if len(w[0]) >= 4 and not w[0].isdigit()]
    typo = {a: best([(d, -n, w) for w, n in long if (d := distance.alignment(a, w)) <= (1 if len(a) < 8 else 2)]) for a in asked if len(a) >= 4 and not a.isdigit()}
    prefix = {a: best([(-n, w) for w, n in long if w.startswith(a) and w != a]) for a in asked if len(a) >= 4}
    got = S.typo_corrections(lost, vocab, keys).where("qid = 1" if keys else "true").collect()
    assert {r["term"]: r["guess"] for r in got} == {a: w for a, w in typo.items() if w}
    got = S.prefix_matches(lost, vocab, keys).where("qid = 1" if keys else "true").collect()
    assert {r["term"]: r["guess"] for r in got} == {a: w for a, w in prefix.items() if w}
    if keys:
        assert S.typo_corrections(lost, vocab, keys).where("qid > 1").count() == 0 and S.prefix_matches(lost, vocab, keys).where("qid > 1").count() == 0


def test_named_pages_are_put_in(spark, sections):
    pages = sections.groupBy("path").agg(F.min("section_id").alias("page_id"), F.min("page_title").alias("title")).select("page_id", "path", "title")
    names = spark.createDataFrame([("Ruby",), ("Block of Ruby",), ("Nest",), ("Owl",)], "name string")
    q = spark.createDataFrame([(1, "what can I do with a block of ruby"), (2, "rubies please"), (3, "owls"), (4, "nothing")], "qid long, query string")
    named = live.named_pages(q, names, sections, pages, ambiguous=["owl"])
    assert plain(named, "qid", "name", "section_id") == [(1, "Block of Ruby", 9), (2, "Ruby", 8)]
    results = spark.createDataFrame([(1, 1, "a", 3, "foxes/red/tail", 9.0, False), (1, 2, "b", 9, "gems/ruby_block", 2.0, True), (2, 1, "a", 50, "my/ruby", 8.0, True), (2, 2, "a", 51, "my/other", 7.0, False), (2, 3, "a", 52, "my/third", 6.0, False)], "qid long, rank long, source string, section_id long, path string, score double, title_match boolean")
    titles = spark.createDataFrame([("b", "gems/ruby_block", "Block of Ruby"), ("a", "my/ruby", "My Ruby"), ("a", "foxes/red/tail", "Fox Tail")], "source string, path string, title string")
    got = plain(live.with_named(results, named, titles), "qid", "rank", "source", "section_id")
    assert got == [(1, 1, "a", 3), (1, 2, "b", 9), (2, 1, "a", 50), (2, 2, "b", 8), (2, 3, "a", 51)]


# Vectors


@pytest.mark.parametrize("n, block", [(1, 4096), (900, 64)])
def test_nearest_vectors_are_those_of_all_pairs(spark, n, block):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 12))
    x[: n // 3] = x[0] + 0.05 * rng.normal(size=(n // 3, 12)) if n > 3 else x[: n // 3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if n > 10:
        x[5] = x[6]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "section_id long, v array<double>")
    q = spark.createDataFrame([(100 + i, x[i].tolist()) for i in range(0, n, 97)] + [(7, (-x[0]).tolist())], "qid long, qv array<double>")
    index = V.VectorIndex.build(v, most=16, block=block)
    for k, least in ((5, -1.0), (n + 3, 0.4)):
        got = {}
        for r in index.nearest(q, k, least).collect():
            got.setdefault(r["qid"], []).append((-round(r["similarity"], 9), -r["section_id"]))
        for r in q.collect():
            cos = x @ np.array(r["qv"])
            want = sorted((-round(float(c), 9), -i) for i, c in enumerate(cos) if c >= least)[:k]
            assert sorted(got.get(r["qid"], [])) == want
    assert index.nearest(q.limit(0), 3).isEmpty() and V.VectorIndex.build(v.limit(0)).nearest(q, 3).isEmpty()


def test_most_lists_stay_closed(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = np.repeat(centres, 60, axis=0) + 0.02 * rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = V.VectorIndex.build(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "section_id long, v array<double>"))
    asked = spark.createDataFrame([(i, x[i * 60].tolist()) for i in range(20)], "qid long, qv array<double>")
    opened = []
    inside = index._inside
    index._inside = lambda pairs, *a: opened.append(pairs.count()) or inside(pairs, *a)
    assert index.nearest(asked, 10).count() == 200
    assert sum(opened) < 0.5 * 20 * index.radii.count(), "lists that can't hold a nearer vector aren't looked into"


def test_texts_as_vectors(spark):
    table = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 4.0]), ("c", [-3.0, 0.0])], "piece string, vector array<float>")
    pieces = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "x"), (3, "x"), (4, "a"), (4, "c"), (5, "b"), (5, "b")], "section_id long, piece string")
    got = {r["section_id"]: [round(x, 6) for x in r["v"]] for r in V.embed(pieces, table).collect()}
    assert got == {1: [1, 0], 2: [0.6, 0.8], 5: [0, 1]}
    assert V.embed(pieces, table.limit(0)).isEmpty()


# Rules


def test_parts_are_put_in_to_the_last():
    parts = {"A": "x{B}", "B": "[{C}]", "C": "y{1,2}"}
    assert rules.expand("{A}-{C}", parts) == "x[y{1,2}]-y{1,2}"
    with pytest.raises(ValueError, match="A > B > A"):
        rules.expand("{A}", {"A": "{B}", "B": "{A}"})
    with pytest.raises(ValueError, match="no part D"):
        rules.expand("{D}", {})
    with pytest.raises(ValueError, match="names no words"):
        rules.rows({"rules": [{"branch": "x", "pattern": "y"}]})
    assert rules.rows({"parts": {"_note": "not a part"}, "rules": [{"branch": "x", "pattern": "(a)(?<subject>b)", "any": ["b", "a", "b"]}]}) == [(0, "x", None, "(a)(?<subject>b)", 2, ["a", "b"])]


def test_rules_from_files(spark, tmp_path):
    file = tmp_path / "rules.json"
    file.write_text(json.dumps(rules.packaged("messages"), indent=1))
    assert rules.read(spark, f"file://{file}") == rules.packaged("messages")


PALETTES = {
    "could you make a palette with mossy stone": ("block", "mossy stone"), "I want a pallete made of basalt": ("block", "basalt"), "block mix featuring oak logs": ("block", "oak logs"),
    "which blocks go well with tuff?": ("block", "tuff"), "what colors should I use with copper": ("block", "copper"), "blocks that go with birch planks": ("block", "birch planks"),
    "I am building with sandstone what else should I use": ("block", "sandstone"), "what goes with granite": ("loose", "granite"), "which looks good next to calcite": ("loose", "calcite"),
    "Another palette please": ("again", None), "a different color scheme": ("again", None), "random palette": ("random", None), "give me some nice palette": ("random", None), "palette ideas": ("random", None),
    "what blocks look good together": ("random", None), "what blocks go with it": ("random", None), "which blocks go with this": ("this", None), "what colors fit with the block in my hand": ("held", None),
    "warm brick palette": ("block", "warm brick"), "how do I use a palette": ("random", None), "what is a palette": "any", "what goes with it": None, "which blocks go with one two three four five": None, "where are foxes": None, "": None,
}


def test_palette_questions(spark):
    content = rules.packaged("palette")
    texts = spark.createDataFrame(list(enumerate(PALETTES)), "id long, t string")
    got = {}
    for r in rules.palettes(rules.hits(texts, "id", "t", rules.table(spark, content)), texts, "id", "t", content).collect():
        got[r["id"]] = ("loose" if r["loose"] else r["ask"], r["block"])
    for i, (text, want) in enumerate(PALETTES.items()):
        if want != "any":
            assert got.get(i) == want, text


TOPICS = {
    "tell me a fun fact about Axolotls please": ("fact", "axolotls"), "any trivia on the ender dragon": ("fact", "the ender dragon"), "make fun of Nox": ("joke", "nox"), "roast me": ("joke", "@me"), "a joke about you": ("joke", "@you"),
    "some tips for mining": ("tip", "mining"), "fun facts about the game": ("fact", ""), "jokes about it": ("joke", ""), "a fact about one two three four five": None, "a joke and a fact about bees": ("fact", "bees"), "no request": None,
}


def test_topic_requests(spark):
    content = rules.packaged("messages")
    texts = spark.createDataFrame(list(enumerate(TOPICS)), "id long, t string")
    hits = rules.hits(texts, "id", "t", rules.table(spark, content)).where("branch = 'topic'")
    got = {r["id"]: (r["kind"], r["subject"]) for r in rules.topics(hits, "id", content).collect()}
    for i, (text, want) in enumerate(TOPICS.items()):
        assert got.get(i) == want, text


def test_lines_about_a_subject(spark):
    lines = spark.createDataFrame([("fact", x) for x in ["Axolotls play dead.", "The Ender Dragon heals.", "Endermen hate water.", "A blast-ronaut flies.", "Prismarine changes its color."]] + [("joke", "Axolotls walk into a bar.")], "pool string, line string")
    asked = ["axolotls", "ender dragon", "enderman", "ron", "prismarin", "axolotel", "the", "", None, "dragon enderman"]
    subjects = spark.createDataFrame([(i, "fact", s) for i, s in enumerate(asked)], "key long, pool string, subject string")
    got = {}
    for r in rules.about(lines, subjects).collect():
        got.setdefault(r["key"], set()).add(r["line"].split()[0] + r["line"].split()[1])
    assert got == {0: {"Axolotlsplay"}, 1: {"TheEnder"}, 2: {"Endermenhate"}, 4: {"Prismarinechanges"}, 5: {"Axolotlsplay"}}


# Routing

#: Who says what when, and the branch (with its detail, and the section that answers).
TALK = [
    (0, "user", "hello", "greeting"), (40, "user", "where is the fox den?", ("answer", 2)), (80, "user", "what was I asking?", ("recall", "question")), (100, "user", "and the tail?", ("answer", 3)),
    (120, "user", "say that again please", ("recall", "repeat")), (150, "user", "you're funny! tell me a joke", ("talk", "joke")), (170, "user", "another one", ("again", "joke")), (469, "user", "one more", ("again", "joke")),
    (769, "user", "another one", ("more", "what")), (800, "user", "which blocks go with tuff", ("palette", "block")), (820, "user", "shuffle", ("again", "palette")), (840, "user", "another one please", ("again", "palette")),
    (850, "user", "tell me a fact about bees", ("topic", "fact")), (860, "user", "more", ("again", "fact")), (870, "user", "shuffle", "unclear"), (900, "user", "where are rubies mined?", ("answer", 8)),
    (920, "user", "how do I get there?", ("answer", 8)), (940, "user", "so it's deep below?", "clarify"), (960, "user", "NO! Stop!", ("talk", "no")), (980, "user", "i saw a submarine", "unclear"), (1000, "user", "have you met Nox yet?", "met"),
    (1020, "user", "who is the player Nox", ("player", "explicit")), (1040, "assistant", "Hi! How are you?", None), (1060, "user", "pretty good thanks", ("feeling", "good")), (1080, "user", "pretty good thanks", "unclear"),
    (1100, "assistant", "What are you up to?", None), (1120, "user", "just building my base", ("doing", "build")), (1140, "user", "thanks! where do owls nest", ("answer", 6)), (1160, "user", "the", "greeting"), (1180, "user", None, "greeting"),
    (1600, "user", "how do I get there?", "greeting"), (1610, "user", "where is the submarine?", "not_found"),
]


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(i, 1, i, at, role, text) for i, (at, role, text, _) in enumerate(TALK)]
    rows += [(1000, 2, 0, 0, "user", "more"), (1001, 2, 1, 10, "system", "x"), (1002, 3, 0, 0, "user", "fox den"), (1003, 3, 1, 20, "user", "is keep inventory on?"), (1004, 3, 2, 30, "user", "how much is a ruby"), (1005, 3, 3, 40, "user", "stop guiding me")]
    return spark.createDataFrame(rows, "mid long, conv long, turn long, at long, role string, text string")


def by_words(sections):
    """A search that counts words, for quick rounds: a named title is sure, equal scores go to the larger id."""
    text = F.concat_ws(" ", "page_title", "text")
    pages = sections.select("section_id", "path", "page_title", F.array_distinct(T.tokens(F.col("page_title"))).alias("title"), F.array_distinct(T.tokens(text)).alias("words")).cache()

    def search(queries):
        q = queries.select("qid", F.array_distinct(T.tokens(F.col("query"))).alias("asked"))
        rows = q.crossJoin(pages).withColumn("matched", F.size(F.array_intersect("asked", "words"))).where("matched > 0")
        rows = rows.withColumn("title_match", F.size(F.array_except("title", "asked")) == 0).withColumn("score", 1.5 * F.col("matched") + F.when(F.col("title_match"), 6.0).otherwise(0.0))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("section_id")))
        results = store.kept(rows.withColumn("rank", rank).where("rank <= 3").drop("title", "words", "asked"), "results")
        best = results.groupBy("qid").agg(F.max("score").alias("best"))
        no = F.lit(False)
        return results, q.select("qid").join(best, "qid", "left").select("qid", F.coalesce("best", F.lit(0.0)).alias("confidence"), no.alias("uncertain"), no.alias("corrected"))

    return search


def test_search_of_a_router(spark, sections, no_synonyms):
    q = spark.createDataFrame([(1, "where is the fox den"), (2, "zzzz")], "qid long, query string")
    results, outcome = R.searcher(I.build(sections, True), no_synonyms)(q)
    top = results.where("rank = 1").first()
    assert (top["qid"], top["section_id"], top["page_title"], top["title_match"]) == (1, 2, "Fox Den", True)
    got = {r["qid"]: (r["confidence"], r["uncertain"], r["corrected"]) for r in outcome.collect()}
    assert got == {1: (top["score"], False, False), 2: (0.0, True, False)}


def test_routing_of_a_chat(spark, sections, talk):
    search = by_words(sections)
    got = {r["mid"]: r for r in R.route(talk, search, rules.packaged("messages"), rules.packaged("palette"), classify.rules(spark), classify.keywords(spark)).collect()}
    assert len(got) == talk.where("role = 'user'").count(), "one row for each message of a user"
    for i, (_, _, text, want) in enumerate(TALK):
        if want is not None:
            r = got[i]
            here = r["branch"] if isinstance(want, str) else (r["branch"], r["section_id"] if isinstance(want[1], int) else r["detail"])
            assert here == want, (i, text, r)
    assert got[16]["query"] == "how do I get Ruby?" and got[17]["subject"] == "Ruby" and got[3]["query"].endswith("and the tail?")
    assert (got[1000]["branch"], got[1000]["detail"]) == ("more", "what") and got[1002]["section_id"] == 2


def test_routing_in_a_game(spark, sections, talk):
    search = by_words(sections)
    asked = []

    def of_settings(rest):
        asked.append(sorted(r["mid"] for r in rest.collect()))
        return rest.where(F.lower("text").contains("inventory")).select("mid", F.lit(7).alias("detail"))

    some = talk.where("conv = 3 or mid in (1, 9, 20)")
    got = {r["mid"]: r for r in R.route(some, search, rules.packaged("messages"), rules.packaged("palette"), classify.rules(spark), classify.keywords(spark), R.GAME, [("settings", of_settings)]).collect()}
    assert {m: r["branch"] for m, r in got.items()} == {1: "answer", 9: "palette", 20: "met", 1002: "answer", 1003: "settings", 1004: "price", 1005: "stop"}
    assert got[1003]["detail"] == "7" and got[1004]["subject"] == "ruby" and asked == [[1, 1002, 1003]], "a dear stage sees only what is left"


def test_long_chain_of_links(spark):
    """Each message asks about the page that answered the one before."""
    names = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("rin", "tol", "vek")]
    data = [(i, f"p/{n}", n.title(), "", f"The {n} leads to {names[(i + 1) % 9]} alone.", "") for i, n in enumerate(names)]
    search = by_words(spark.createDataFrame(data, COLUMNS))
    rows = [(0, 1, 0, 0, "user", f"where is {names[0]}?")] + [(i, 1, i, 20 * i, "user", "where does it lead?") for i in range(1, 5)]
    messages = spark.createDataFrame(rows, "mid long, conv long, turn long, at long, role string, text string")
    got = {r["mid"]: r for r in R.route(messages, search, rules.packaged("messages"), rules.packaged("palette"), classify.rules(spark), classify.keywords(spark)).collect()}
    page = names[0].title()
    for i in range(1, 5):
        assert got[i]["query"] == f"where does {page} lead?"
        page = data[got[i]["section_id"]][2]


def test_a_round_searches_once(spark, sections):
    """A follow-up is asked alone and with the question before it in one search, so there are as many searches as rounds (F7, F9)."""
    plain_search, calls = by_words(sections), []

    def search(queries):
        calls.append(sorted(r["query"] for r in queries.collect()))
        return plain_search(queries)

    rows = [(1, 1, 0, 0, "user", "where is the fox den"), (2, 1, 1, 20, "user", "and what about the zzzz")]
    messages = spark.createDataFrame(rows, "mid long, conv long, turn long, at long, role string, text string")
    R.searched(messages, spark.createDataFrame([], "mid long, pool string, rest string"), search).collect()
    assert len(calls) == 2 and len(calls[0]) == 1 and len(calls[1]) == 2


def test_overviews_are_only_scored_where_there_are_some(spark, sections, no_synonyms, monkeypatch):
    def of(self, pages):
        raise AssertionError("no list was asked for")

    monkeypatch.setattr(S.Bests, "of", of)
    q = spark.createDataFrame([(1, "where is the fox den")], "qid long, query string")
    assert S.find(I.build(sections, True), q, no_synonyms).first()["section_id"] == 2


def test_pairs_and_terms_are_counted_without_an_exchange_of_their_rows(spark, sections):
    """what is shuffled are counts, and a bigram's tokens are made once."""
    from quillspark.functions import text as T

    ix = I.build(sections, True)
    for df, one in ((ix.terms, "term"), (ix.pairs, "pair")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "section_id" not in plan.split("Aggregate")[1].split("\n")[0], "no grouping by section"
        rows = I.postings(I.cleaned(sections)) if one == "term" else I.bigram_postings(I.cleaned(sections))
        assert {(r[one], r["df"]) for r in df.collect()} == {(r[one], r["n"]) for r in rows.groupBy(one).agg(F.count("*").alias("n")).collect()}
    plan = spark.range(1).select(T.bigrams(T.raw_words(F.col("id").cast("string"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_an_index_holds_what_its_searches_need(spark, sections):
    """F15 to F19: no pairs where words alone are searched, and nothing but the vocabulary where words are only looked up."""
    from quillspark.operators.search import plain_search

    q = spark.createDataFrame([(1, "where is the fox den")], "qid long, query string")
    whole = store.shared_index(sections.transform(lambda d: store.kept(d, "levels")), "levels-all")
    rows = store.kept(sections, "levels")
    words = store.shared_index(rows, "levels", "postings")
    assert words.bigrams is None and words.pairs is None and words.features is None
    assert plain_search(words, q).collect() == plain_search(whole, q).collect()
    known = store.shared_index(store.kept(sections, "levels"), "levels-terms", "terms")
    assert known.postings is None and known.sections is None
    for ix in (words, known):
        assert {tuple(r) for r in ix.terms.select("term", "df", "idf").collect()} == {tuple(r) for r in whole.terms.select("term", "df", "idf").collect()}
    assert store.shared_index(rows, "levels", "terms").postings is not None, "a fuller index is taken if it is there"


def test_settings_are_written_once(spark, monkeypatch):
    """what ranking reads several times is kept."""
    from quillspark.operators import settings

    names = []
    monkeypatch.setattr(settings, "kept", lambda df, name: names.append(name) or store.kept(df, name), raising=False)
    s = spark.createDataFrame([(1, "Red Things", "ruby limit", "brand 1", "5")], "setting_id long, pack string, label string, key_words string, value string")
    got = settings.search(s, spark.createDataFrame([(7, "what is the ruby limit")], "qid long, query string")).collect()
    assert [(r["qid"], r["setting_id"]) for r in got] == [(7, 1)]
    assert {"settings", "asked-settings", "setting-terms", "setting-words"} <= set(names)


# All questions against all sections


WIDE = [(i, f"{'foxes' if i % 3 else 'owls'}/{'home' if i % 11 == 0 else 'red/overview' if i % 13 == 0 else f'red/changelog_{i}' if i % 17 == 0 else f'red/{i // 2}'}", ["Fox Den", "Owl", "Main"][i % 3], ["Overview", "Commands", "Den", ""][i % 4],
         " ".join(["fox den", "red owl", "snow berry nest", "woods fox den"][(i * 7 + j) % 4] for j in range(i % 5 + 1)), "en") for i in range(240)]
ASKED = ["fox den", "which foxes are there in foxes", "where is the owl nest", "lair snow", "berry commands", "red owl changelog", "foxes", "wods", "nothing at all", "zzzz"]


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_scan_is_the_plain_score(spark, no_synonyms, monkeypatch, block):
    """Blocks give the best pages, given pages and places of the plan that makes a row of each question and section, and few rows."""
    from quillspark.operators import scan

    monkeypatch.setattr(scan, "BLOCK", block)
    monkeypatch.setattr(scan, "CHUNK", 4)
    ix = I.build(spark.createDataFrame(WIDE, COLUMNS), True)
    q = spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string")
    groups = S.analyze(ix, q, no_synonyms)
    bests = S.Bests(ix, q, groups, 0.5, None, None, None)
    shown = ["qid", "section_id", "path", "score", "matched", "title_match", "titled", "hinted", "of_project"]
    with S.by_page(q):
        every = store.kept(S.page_bests(S.score(ix, q, groups), 0.0), "every")
    want = store.kept(S.cut(every.where("score >= 0.5")), "want")
    first = bests.first(3)
    assert want.count() > 10 and plain(S.cut(first), *shown, "rank") == plain(want, *shown, "rank")
    if block > 240:
        assert first.count() <= 3 * len(ASKED) * bests.scan.parts and every.count() > first.count()
    pages = store.kept(every.where("section_id % 5 = 0").select("qid", "path"), "given-pages")
    given = every.join(pages, ["qid", "path"])
    assert given.count() > 50 and plain(bests.of(pages), *shown) == plain(given, *shown)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("section_id"))) - 1
    placed = every.where("score >= 0.5").withColumn("place", place).join(pages, ["qid", "path"])
    assert plain(bests.placed(pages), "qid", "path", "section_id", "score", "place") == plain(placed, "qid", "path", "section_id", "score", "place")


def test_counted_index_is_the_plain_one(spark, no_synonyms):
    """Words, stems, statistics and searches of the index that is counted in Python are those of the index's plans."""
    from quillspark.operators import counted

    odd = "Über ÅNGSTRÖM cafés Kelvin glasses boxes axes status parties running tied mined wolves İs is gas ringed things x1s 中文 àb Straße bus kisses"
    rows = [*WIDE, (900, "foxes/red/900", "Fox Den", "Den", odd, None), (901, "foxes/red/901", "Your", None, "Your content here", "en"), (902, "foxes/x_y", "A", "", None, "")]
    df = spark.createDataFrame(rows, COLUMNS)
    plain_words = [r["w"] for r in df.select(F.explode(T.raw_words(F.col("text"))).alias("w")).collect()]
    assert sorted(plain_words) == sorted(w for r in rows for w in counted.words(r[4] or ""))
    stems = df.select(F.explode(T.raw_words(F.col("text"))).alias("w")).distinct().select("w", T.stem(F.col("w")).alias("s")).collect()
    assert all(counted.stem(r["w"]) == r["s"] for r in stems)
    ix, mine = I.build(df, True), counted.index(df, S.features)
    assert plain(mine.terms, "term", "df", "idf") == plain(ix.terms, "term", "df", "idf")
    assert plain(mine.corpus, "n", "avg_len") == plain(ix.corpus, "n", "avg_len")
    q = spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string")
    shown = ["qid", "rank", "section_id", "score", "matched", "title_match"]
    assert plain(S.find(mine, q, no_synonyms), *shown) == plain(S.find(ix, q, no_synonyms), *shown)
