"""Batch search: many queries against the index at once, keyed by ``qid``.

Everything is driven by the postings of the query's terms, so sections without any of them are never read.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import distance, text as T
from quillspark.operators.index import ASKED_ROWS, K1, Index, beside, bm25, only, sent, vocabulary
from quillspark.operators.store import kept

# Fixed values of the ranking.
SYNONYM_WEIGHT, SYNONYM_ONLY_WEIGHT, TYPO_WEIGHT, PREFIX_WEIGHT = 0.6, 0.9, 0.7, 0.5
BIGRAM_WEIGHT = 1.5
TITLE_BONUS, HEADING_BONUS, HINT_BONUS, PROJECT_BONUS, INTEREST_BONUS = 2.0, 1.0, 2.5, 3.0, 2.5
MIN_SCORE, RELATIVE_CUTOFF, LIMIT = 2.0, 0.35, 3
CHANGELOG_FACTOR, TECHNICAL_FACTOR = 0.5, 0.4
CHANGELOG_WORDS = ["changelog", "change", "update", "patch", "new", "added", "release"]
TECHNICAL_WORDS = "command commands summon give block blocks entity entities loot table tables contents made composed structure file nbt".split()
TECHNICAL_HEADINGS = ["summon command", "commands", "blocks", "entities", "loot tables", "per-structure file contents", "contents"]
GENERIC_TITLES = ["main", "home"]
QUESTION_WORDS = "where which would could should there their about please someone anyone something".split()
WHAT_TYPOS = "wat wht waht whta whats wats".split()
RRF_K, SEMANTIC_WEIGHT, SEMANTIC_CANDIDATES, SEMANTIC_SECTIONS, SEMANTIC_MIN, SEMANTIC_SCORE = 10, 0.6, 10, 40, 0.40, 9.0
SURE_SCORE, SURE_TITLE_SCORE, GUESS_SCORE = 12.0, 7.0, 4.0

#: Columns of what a search shows.
SHOWN = ["qid", "section_id", "path", "score", "matched", "title_match", "titled", "hinted", "of_project", "rank"]

#: Stopwords, synonym terms and the like that a question may hold; queries are few beside sections.
QUERY_SCHEMA = "qid long, query string"


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid, pos, word, term``: each term of a query once, where it stands first."""
    rows = T.terms(queries.select("qid", "query"), "query")
    return rows.groupBy("qid", "term").agg(F.min(F.struct("pos", "word")).alias("f")).select("qid", "f.pos", "f.word", "term")


def plain_search(index: Index, queries: DataFrame, limit: int = LIMIT, min_score: float = 0.0) -> DataFrame:
    """``qid, rank, section_id, score``: BM25 over exact terms; ties go to the larger section id."""
    q = kept(query_terms(queries).select("qid", "term"), "asked")
    score = (weighed(index, q) if index.keys else dealt(index, q, pieces(index, q))).groupBy("qid", "section_id").agg(F.sum("s").alias("score"))
    return top(score.where(F.col("score") >= min_score), limit)


#: Postings beside questions that a task takes in.
HITS = 1 << 21


def pieces(index: Index, asked: DataFrame) -> int:
    """Into how many parts the sections are dealt, by the postings that all ``asked`` terms meet."""
    n = only(index, asked)[1].join(sent(asked.groupBy("term").agg(F.count("*").alias("times"))), "term").agg(F.sum(F.col("df") * F.col("times"))).first()[0]
    return max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n or 0) // HITS)


def dealt(index: Index, asked: DataFrame, parts: int, by: str = "section_id", extra: DataFrame | None = None) -> DataFrame:
    """What ``weighed`` gives, of an index of one corpus, with all postings of a section in one part.

    Postings are far fewer than postings beside questions: they are weighed and dealt once, then meet the asked terms where they
    are, so that sums by ``by`` and the question need no exchange. ``extra`` (section_id and ``by``) tells the parts, if not by section.
    """
    tf, stats = only(index, asked)
    of = index.lengths if extra is None else index.lengths.join(extra, "section_id")
    rows = tf.join(of, "section_id").join(sent(stats.select("term", "idf")), "term")
    rows = beside(rows, index.corpus.select("avg_len"), [])
    rows = rows.select(*{"section_id": 0, by: 0}, "term", bm25(F.col("tf"), F.col("length"), F.col("avg_len"), F.col("idf")).alias("s"))
    return rows.repartition(parts, by).join(sent(asked, ASKED_ROWS), "term")


def weighed(index: Index, asked: DataFrame) -> DataFrame:
    """The postings of the ``asked`` terms (qid, term and more) with ``s``, their BM25 weight."""
    on = [*index.keys, "term"]
    tf, stats = only(index, asked)
    hits = tf.join(asked, on).join(sent(stats.select(*on, "idf")), on).join(index.lengths, "section_id")
    hits = beside(hits, index.corpus.select(*index.keys, "avg_len"), index.keys)
    return hits.withColumn("s", bm25(F.col("tf"), F.col("length"), F.col("avg_len"), F.col("idf")))


def top(scored: DataFrame, limit: int) -> DataFrame:
    """Scores are rounded before they rank, so equal sums in another order stay ties."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("section_id"))
    ranked = scored.withColumn("score", F.round("score", 4)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)  # on the bare number, so that tasks cut before the exchange
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def misspelled_question_word(word: Column) -> Column:
    near = F.exists(F.array(*map(F.lit, QUESTION_WORDS)), lambda q: distance.within_one(word, q))
    return word.isin(WHAT_TYPOS) | ((F.length(word) >= 4) & near)


def _near(term: Column, guess: Column) -> Column:
    """Holds for all words within a typo's edits, and for few others."""
    far = (F.abs(F.length(guess) - F.length(term)) <= 2) & (F.levenshtein(term, guess, 4) >= 0)  # a swap is two changes
    return F.when(F.length(term) < 8, distance.within_one(term, guess)).otherwise(far)


def _goes_on(term: Column, guess: Column) -> Column:
    return (F.length(guess) > F.length(term)) & F.startswith(guess, term)


def _pool_guesses(index: Index, lost: DataFrame) -> DataFrame:
    """``term, df`` by the index's keys: the words of its pools that a ``lost`` one (keys and term) may be; each pool's words are counted once."""
    asked = kept(lost.where(F.length("term") >= 4).join(index.pools, index.keys), "lost-pools")
    words = asked.select("pool", "term").distinct()
    there = index.postings.join(sent(words.select("pool").distinct(), ASKED_ROWS), "pool", "left_semi").groupBy("pool", "term").agg(F.count("*").alias("df"))
    near = vocabulary(there).withColumnRenamed("term", "guess").join(sent(words, ASKED_ROWS), "pool").where(_near(F.col("term"), F.col("guess")) | _goes_on(F.col("term"), F.col("guess")))
    each = asked.join(near, ["pool", "term"]).select(*index.keys, "pool", F.col("guess").alias("term"), "df").distinct()
    return kept(each.groupBy(*index.keys, "term").agg(F.sum("df").alias("df")), "guesses")


def typo_corrections(unknown: DataFrame, index_terms: DataFrame, keys: list[str] = []) -> DataFrame:
    """``term, guess, dist`` (and ``keys``) for unknown terms: the nearest word of the vocabulary within one edit (two from eight letters).

    Candidates come from an equi-join on deletion neighbourhoods, so no term meets the whole vocabulary. With ``keys`` it meets
    that of its own corpus, which is smaller than its neighbourhoods. Of equally near ones the more frequent, then the
    alphabetically first.
    """
    words = unknown.select(*keys, "term").distinct().where((F.length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$"))
    limit = F.when(F.length("term") < 8, 1).otherwise(2)
    vocab = vocabulary(index_terms).withColumnRenamed("term", "guess")

    def within(asked: Column, guess: Column, edits: int) -> DataFrame:
        near = words.where(asked).withColumn("key", F.explode(distance.deletions(F.col("term"), edits)))
        return near.join(vocab.where(guess).withColumn("key", F.explode(distance.deletions(F.col("guess"), edits))), [*keys, "key"]).select(*keys, "term", "guess", "df")

    if keys:
        pairs = vocab.join(sent(words, ASKED_ROWS), keys).where(_near(F.col("term"), F.col("guess"))).select(*keys, "term", "guess", "df")
    else:
        pairs = within(F.length("term") < 8, F.length("guess") <= 8, 1)
    if not keys and not words.where(F.length("term") >= 8).isEmpty():  # the neighbourhood of two deletions is large; it is only made when a long word needs it
        longest = words.agg(F.max(F.length("term"))).first()[0]
        pairs = pairs.unionAll(within(F.length("term") >= 8, F.length("guess").between(6, longest + 2), 2))
    pairs = pairs.distinct()
    near = pairs.withColumn("dist", distance.alignment_column(F.col("term"), F.col("guess"))).where(F.col("dist") <= limit)
    w = Window.partitionBy(*keys, "term").orderBy("dist", F.desc("df"), "guess")
    return near.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*keys, "term", "guess", "dist")


def prefix_matches(unknown: DataFrame, index_terms: DataFrame, keys: list[str] = []) -> DataFrame:
    """``term, guess`` (and ``keys``): the first word of the vocabulary that goes on after the term."""
    words = unknown.select(*keys, "term").distinct().where(F.length("term") >= 4)
    vocab = vocabulary(index_terms).withColumnRenamed("term", "guess").where(F.length("guess") > 4)
    if keys:  # a term meets the words of its own corpus
        found = vocab.join(sent(words, ASKED_ROWS), keys).where(_goes_on(F.col("term"), F.col("guess")))
    else:
        starts = F.transform(F.sequence(F.lit(4), F.greatest(F.length("guess") - 1, F.lit(4))), lambda n: F.substring("guess", F.lit(1), n))
        found = words.join(vocab.withColumn("term", F.explode(starts)).join(sent(words), "term", "left_semi"), "term")
    w = Window.partitionBy(*keys, "term").orderBy(F.desc("df"), "guess")
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*keys, "term", "guess")


def analyze(index: Index, queries: DataFrame, synonyms: DataFrame, names: DataFrame | None = None, guesses: bool = True) -> DataFrame:
    """``qid, pos, word, term, exact, alternatives`` (array of terms and weight), ``correction`` for each query word that counts.

    ``synonyms``: (word, synonym). ``names``: terms of names that are only corrected to something that goes on after them, or
    that they go on after. The rows are few beside the index and are written, as what follows reads them several times.
    """
    on = [*index.keys, "term"]
    of_word = _synonym_terms(synonyms)
    q = query_terms(queries)
    expanded = q.select("qid", "term", "word").join(of_word, F.col("word") == F.col("w")).where("s <> term")
    wanted = kept(q.select("qid", "term").unionAll(expanded.select("qid", "s")).distinct(), "wanted")
    there = kept(only(index, wanted)[1].select(*on).distinct(), "known")
    q = q.join(there.withColumn("known", F.lit(True)), on, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    usable = expanded.join(there.withColumnRenamed("term", "s"), [*index.keys, "s"], "left_semi").groupBy("qid", "term").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("found"))
    q = q.join(usable.select("qid", "term", F.col("found.s").alias("synonym")), ["qid", "term"], "left")
    if names is not None:
        q = q.join(names.select("term", F.lit(True).alias("name")).distinct(), "term", "left").withColumn("name", F.coalesce("name", F.lit(False)))
    else:
        q = q.withColumn("name", F.lit(False))
    nothing = ~F.col("known") & F.col("synonym").isNull()
    q = q.where(~(nothing & ~F.col("name") & misspelled_question_word(F.col("word"))))
    guess, weight = F.lit(None).cast("string"), F.lit(0.0)
    if guesses:
        q = kept(q, "asked")
        lost = q.where(nothing).select(*on).distinct()
        if not lost.isEmpty():
            there = _pool_guesses(index, lost) if index.pools is not None else index.terms
            typo = typo_corrections(lost, there, index.keys).select(*on, F.col("guess").alias("typo"))
            prefix = prefix_matches(lost, there, index.keys).select(*on, F.col("guess").alias("prefix"))
            q = q.join(typo, on, "left").join(prefix, on, "left")
            fits = lambda g: ~F.col("name") | F.startswith(g, F.col("term")) | F.startswith(F.col("term"), g)
            typo_fits = F.when(fits(F.col("typo")), F.col("typo"))
            guess = F.when(nothing, F.coalesce(typo_fits, F.when(F.col("typo").isNull(), F.when(fits(F.col("prefix")), F.col("prefix")))))
            weight = F.when(F.col("typo").isNotNull(), F.lit(TYPO_WEIGHT)).otherwise(F.lit(PREFIX_WEIGHT))
    q = q.withColumns({"guess": guess, "guess_weight": weight})
    alternatives = F.array(
        F.when(F.col("known"), F.struct(F.array("term").alias("terms"), F.lit(1.0).alias("weight"))),
        F.when(F.col("synonym").isNotNull(), F.struct(F.col("synonym").alias("terms"), F.when(F.col("known"), SYNONYM_WEIGHT).otherwise(SYNONYM_ONLY_WEIGHT).alias("weight"))),
        F.when(F.col("guess").isNotNull(), F.struct(F.array("guess").alias("terms"), F.col("guess_weight").alias("weight"))),
    )
    exact = F.col("known") | F.col("synonym").isNotNull()
    return kept(q.select("qid", "pos", "word", "term", exact.alias("exact"), F.filter(alternatives, lambda a: a.isNotNull()).alias("alternatives"), F.col("guess").alias("correction")), "groups")


def _synonym_terms(synonyms: DataFrame) -> DataFrame:
    rows = T.terms(synonyms.select(F.col("word").alias("w"), "synonym"), "synonym")
    return rows.select("w", F.col("pos").alias("at"), F.col("term").alias("s"))


def features(sections: DataFrame) -> DataFrame:
    """Term sets of each section's title, heading and project folder, as sorted arrays."""
    project = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    folder = T.tokens(F.translate(project, "_", " "))
    home = F.col("path").endswith("/home") | F.lower("page_title").isin(GENERIC_TITLES)
    vanilla = F.col("vanilla") if "vanilla" in sections.columns else F.lit(False)
    none = F.array().cast("array<string>")
    title = F.array_except(T.tokens(F.col("page_title")), F.array(*map(F.lit, GENERIC_TITLES)))
    heading = F.coalesce("heading", F.lit(""))
    hint = F.array_distinct(T.tokens(heading, None))
    lists = T.stems(T.LIST_HEADINGS.split())
    hint = F.array_union(hint, F.array_intersect(T.tokens(F.col("page_title"), None), lists))
    return sections.select(
        "section_id", "path", "page_title", "heading", home.alias("home"), vanilla.alias("vanilla"),
        F.array_distinct(F.when(home, F.array_union(title, folder)).otherwise(title)).alias("title_terms"),
        F.when(heading != F.col("page_title"), F.array_distinct(T.tokens(heading))).otherwise(none).alias("heading_terms"),
        F.when(home & ~vanilla, F.array_union(hint, lists)).otherwise(hint).alias("hint_targets"),
        F.when(home & ~vanilla, F.array_distinct(folder)).otherwise(none).alias("project_terms"),
        F.when(vanilla, none).otherwise(F.array_distinct(folder)).alias("folder_terms"),
    )


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def score(index: Index, queries: DataFrame, groups: DataFrame, interests: DataFrame | None = None, priors: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """``qid, section_id, path, score, matched, title_match`` and more: the full score of every section that has a query word.

    Words and pairs, times the root of coverage; then the bonuses; then damping; the prior (qid, path, prior) and interests
    (qid, project, share) last. ``hints`` (qid, hint): heading terms that answer a question besides those that its words tell.
    """
    keys = index.keys
    active = groups.where(F.size("alternatives") > 0)
    alts = active.select("qid", "pos", F.posexplode("alternatives").alias("alt", "a")).select("qid", "pos", "alt", F.col("a.weight").alias("weight"), F.explode("a.terms").alias("term"))
    feats = (index.features if index.features is not None else features(index.sections)).withColumn("project_name", F.split_part("path", F.lit("/"), F.lit(1)))
    if keys:
        by, hits = [], weighed(index, alts).repartition("qid", "section_id")  # the three sums below need no other exchange
    else:  # dealt by page, so that all of a question's sums over a page's sections stay in one task
        alts = kept(alts, "alternatives")
        feats = feats.withColumn("page", F.xxhash64("path"))
        parts = pieces(index, alts)
        by, hits = ["page"], dealt(index, alts, parts, "page", feats.select("section_id", "page"))
    each = hits.groupBy(*by, "qid", "section_id", "pos", "alt").agg((F.first("weight") * F.sum("s")).alias("s"))
    best = each.groupBy(*by, "qid", "section_id", "pos").agg(F.max("s").alias("s")).where("s > 0")
    words = best.groupBy(*by, "qid", "section_id").agg(F.sum("s").alias("words"), F.count("*").alias("matched"))
    info = kept(asked_info(queries, active, hints), "info")
    if not keys:
        if index.bigrams is not None:  # beside the section's features, so that the many rows of words are not dealt anew
            of_section = _pair_scores(index, active, feats).groupBy("section_id").agg(F.map_from_entries(F.collect_list(F.struct("qid", "pairs"))).alias("pairs_of"))
            feats = feats.join(of_section, "section_id", "left")
        rows = words.join(feats.repartition(parts, "page").hint("shuffle_hash"), ["page", "section_id"]).join(sent(info), "qid")
        rows = rows.withColumn("pairs", F.try_element_at("pairs_of", F.col("qid")) if index.bigrams is not None else F.lit(0.0))
    elif index.bigrams is not None:
        rows = words.join(info, "qid").join(feats, "section_id").join(_pair_scores(index, active, feats), ["qid", "section_id"], "left")
    else:
        rows = words.join(info, "qid").join(feats, "section_id").withColumn("pairs", F.lit(0.0))
    title = (F.size("title_terms") > 0) & subset(F.col("title_terms"), F.col("asked"))
    bonus = F.when(title, TITLE_BONUS).otherwise(0.0) + F.when(title & F.arrays_overlap("folder_terms", "asked"), TITLE_BONUS).otherwise(0.0)
    heading = (F.size("heading_terms") > 0) & subset(F.col("heading_terms"), F.col("asked"))
    hinted = F.arrays_overlap("hint_targets", "hints")
    project = (F.size("project_terms") > 0) & subset(F.col("asked"), F.col("project_terms"))
    bonus = bonus + F.when(heading, HEADING_BONUS).otherwise(0.0) + F.when(hinted, HINT_BONUS).otherwise(0.0)
    bonus = bonus + F.when(project, PROJECT_BONUS).otherwise(0.0)
    damp = F.when(~F.col("about_changes") & F.lower("path").contains("changelog"), CHANGELOG_FACTOR).otherwise(1.0)
    damp = damp * F.when(~F.col("about_technique") & F.lower("heading").isin(TECHNICAL_HEADINGS), TECHNICAL_FACTOR).otherwise(1.0)
    total = ((F.col("words") + F.coalesce("pairs", F.lit(0.0))) * F.sqrt(F.col("matched") / F.col("active")) + bonus) * damp
    if priors is not None:
        rows = rows.join(priors.select("qid", "path", "prior"), ["qid", "path"], "left")
        total = total + F.coalesce("prior", F.lit(0.0))
    if interests is not None:
        rows = rows.join(interests.select("qid", F.col("project").alias("project_name"), "share"), ["qid", "project_name"], "left")
        total = total + INTEREST_BONUS * F.coalesce("share", F.lit(0.0))
    return rows.select(*by, "qid", "section_id", "path", total.alias("score"), "matched", (title | heading).alias("title_match"), title.alias("titled"), hinted.alias("hinted"), project.alias("of_project"))


def asked_info(queries: DataFrame, active: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``qid, active, asked, hints, about_changes, about_technique``: what bonuses and damping need of a question."""
    info = active.groupBy("qid").agg(F.count("*").alias("active"), F.array_distinct(F.flatten(F.flatten(F.collect_list(F.col("alternatives.terms"))))).alias("asked"))
    asked_hints = T.question_hints(F.col("query"))
    if hints is not None:
        more = hints.groupBy("qid").agg(F.collect_set("hint").alias("more"))
        of = queries.join(more, "qid", "left").select("qid", F.array_union(asked_hints, F.coalesce("more", F.array().cast("array<string>"))).alias("hints"))
    else:
        of = queries.select("qid", asked_hints.alias("hints"))
    about = lambda words: F.arrays_overlap("asked", words)
    return info.join(of, "qid").withColumns({"about_changes": about(F.array(*map(F.lit, CHANGELOG_WORDS))), "about_technique": about(T.stems(list(TECHNICAL_WORDS)))})


def asked_pairs(active: DataFrame, feats: DataFrame) -> DataFrame:
    """``qid, pair, first, second, f1, f2``: neighbouring words of questions, and whether they name a project."""
    order = Window.partitionBy("qid").orderBy("pos")
    last = F.element_at(F.col("alternatives")[0]["terms"], -1)
    follows = active.withColumn("second", F.lead(F.col("alternatives")[0]["terms"][0]).over(order)).where("second is not null")
    asked = follows.select("qid", last.alias("first"), "second").withColumn("pair", F.concat_ws(" ", "first", "second"))
    folders = feats.select(F.explode("folder_terms").alias("t")).distinct()
    named = asked.join(folders.select(F.col("t").alias("first"), F.lit(True).alias("f1")), "first", "left").join(folders.select(F.col("t").alias("second"), F.lit(True).alias("f2")), "second", "left")
    return kept(named, "named-pairs")


def _pair_scores(index: Index, active: DataFrame, feats: DataFrame) -> DataFrame:
    """``qid, section_id, pairs``: neighbouring query words that are neighbours in a section, but not those that name another project."""
    on = [*index.keys, "pair"]
    asked = asked_pairs(active, feats)
    tf, stats = only(index, asked, "pair")
    found = tf.join(asked, on).join(sent(stats.select(*on, "idf")), on).join(feats.select("section_id", "folder_terms"), "section_id")
    own = lambda flag, c: F.col(flag).isNull() | F.array_contains("folder_terms", F.col(c))
    found = found.where(own("f1", "first") & own("f2", "second"))
    return found.groupBy("qid", "section_id").agg(F.sum(BIGRAM_WEIGHT * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1)).alias("pairs"))


def page_bests(scored: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The best section of each page of each query, of sections with ``min_score`` or more; of equals the first."""
    scored = scored.withColumn("score", F.round("score", 4)).where(F.col("score") >= min_score)
    page = Window.partitionBy(*[c for c in scored.columns if c == "page"], "qid", "path").orderBy(F.desc("score"), "section_id")
    return scored.withColumn("nth", F.row_number().over(page)).where("nth = 1").drop("nth")


def cut(bests: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best pages of each query, and of those the ones near the first."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("section_id"))
    ranked = bests.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))
    first = F.max("score").over(Window.partitionBy("qid"))
    return ranked.withColumn("first", first).where(F.col("score") >= F.col("first") * RELATIVE_CUTOFF).drop("first")


def best_pages(scored: DataFrame, limit: int = LIMIT, min_score: float = MIN_SCORE) -> DataFrame:
    return cut(page_bests(scored, min_score), limit)


def with_overview(ranked: DataFrame, scored: Callable[[DataFrame], DataFrame], index: Index, queries: DataFrame, groups: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A list question whose two best pages are siblings is answered by their overview, in front of them and just above the best.

    That is the folder's own overview page, else the section of the project's home page whose heading the question has most
    words of. A best page with the asked title is such a list already. ``scored``: the best sections of given pages (qid, path),
    which is only asked if there are overviews.
    """
    parent = F.regexp_replace("path", "/[^/]*$", "")
    lists = queries.where(F.size(F.array_intersect(T.question_hints(F.col("query")), T.stems(T.LIST_HEADINGS.split()))) > 0).select("qid")
    two = ranked.where("rank <= 2").withColumn("parent", parent).groupBy("qid").agg(
        F.count("*").alias("n"), F.count_distinct("parent").alias("parents"), F.min("parent").alias("parent"), F.max(F.col("titled") & (F.col("rank") == 1)).alias("named"), F.max("score").alias("top")
    )
    two = kept(two.where("n = 2 and parents = 1 and not named").join(lists, "qid", "left_semi").select("qid", "parent", "top"), "siblings")
    if two.isEmpty():
        return ranked.select(*SHOWN)
    feats = index.features if index.features is not None else features(index.sections)
    feats = feats.withColumn("folder", parent)
    own = feats.where(F.col("path").endswith("/overview") | F.contains(F.lower("page_title"), F.lit("overview"))).groupBy("folder").agg(F.min("section_id").alias("section_id"))
    by_folder = two.join(own.withColumnRenamed("folder", "parent"), "parent").select("qid", "section_id", "top")
    asked = groups.where(F.size("alternatives") > 0).groupBy("qid").agg(F.array_distinct(F.flatten(F.flatten(F.collect_list(F.col("alternatives.terms"))))).alias("asked"))
    homes = feats.where("home and not vanilla and size(heading_terms) > 0").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project"), "section_id", "heading_terms")
    rest = two.join(by_folder, "qid", "left_anti").withColumn("project", F.split_part("parent", F.lit("/"), F.lit(1))).join(asked, "qid").join(homes, "project").where(subset(F.col("heading_terms"), F.col("asked")))
    by_home = rest.groupBy("qid", "top").agg(F.max_by("section_id", F.struct(F.size("heading_terms"), -F.col("section_id"))).alias("section_id")).select("qid", "section_id", "top")
    hints = queries.select("qid", T.question_hints(F.col("query")).alias("hints"))
    found = by_folder.unionAll(by_home).join(feats.select("section_id", "path", "title_terms", "heading_terms", "hint_targets", "project_terms"), "section_id").join(asked, "qid").join(hints, "qid")
    named = lambda c: (F.size(c) > 0) & subset(F.col(c), F.col("asked"))
    found = kept(found, "overviews")
    if found.isEmpty():
        return ranked.select(*SHOWN)
    found = found.join(scored(found.select("qid", "path").distinct()).select("qid", "section_id", "matched"), ["qid", "section_id"], "left")
    front = found.select(
        "qid", "section_id", "path", F.round(F.col("top") + 0.01, 4).alias("score"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), (named("title_terms") | named("heading_terms")).alias("title_match"),
        named("title_terms").alias("titled"), F.arrays_overlap("hint_targets", "hints").alias("hinted"),
        ((F.size("project_terms") > 0) & subset(F.col("asked"), F.col("project_terms"))).alias("of_project"), F.lit(0).cast("long").alias("rank"),
    )
    others = ranked.join(front.select("qid", "path"), ["qid", "path"], "left_anti")
    order = Window.partitionBy("qid").orderBy("rank")
    return front.select(*SHOWN).unionByName(others.select(*SHOWN)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def find_all(
    index: Index, queries: DataFrame, synonyms: DataFrame, names: DataFrame | None = None, limit: int = LIMIT, min_score: float = MIN_SCORE,
    interests: DataFrame | None = None, guesses: bool = True, priors: DataFrame | None = None, hints: DataFrame | None = None,
) -> tuple[DataFrame, "Bests", DataFrame]:
    """What ``find`` shows, the best sections of pages with ``min_score`` (``Bests``), and the groups of ``analyze``."""
    groups = analyze(index, queries, synonyms, names, guesses)
    bests = Bests(index, queries, groups, min_score, interests, priors, hints)
    with by_page(queries):
        ranked = kept(cut(bests.first(limit), limit), "ranked")
    return kept(with_overview(ranked, bests.of, index, queries, groups, limit), "shown"), bests, groups


@contextmanager
def by_page(df: DataFrame) -> Iterator[None]:
    """Lets rows that are dealt by page meet a section's features by page and section without being dealt anew."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    conf = df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, "false")
    try:
        yield
    finally:
        conf.set(name, before)


class Bests:
    """The best section of each page of each query: nearly every section is one of some query, so all of them are never written."""

    def __init__(self, index: Index, queries: DataFrame, groups: DataFrame, min_score: float, interests: DataFrame | None, priors: DataFrame | None, hints: DataFrame | None):
        self.index, self.queries, self.groups, self.min_score, self.more = index, queries, groups, min_score, (interests, priors, hints)
        self.scan = None
        if not index.keys and interests is None and priors is None:  # one corpus for all questions
            from quillspark.operators.scan import Scan

            self.scan = Scan.of(index, queries, groups, hints)

    def first(self, limit: int) -> DataFrame:
        """The best ``limit`` pages of each query at least."""
        return page_bests(self.scan.bests(limit, self.min_score), self.min_score) if self.scan else self.all(self.min_score)

    def all(self, min_score: float) -> DataFrame:
        return page_bests(score(self.index, self.queries, self.groups, *self.more), min_score)

    def of(self, pages: DataFrame) -> DataFrame:
        """Those of the given pages (qid, path) with a score of 0 or more: only these pages' postings meet only their queries."""
        ix, pages = self.index, kept(pages, "pages")
        if self.scan:
            return self.scan.given(pages)
        feats = ix.features if ix.features is not None else features(ix.sections)
        ids = kept(feats.join(pages.select("path").distinct(), "path", "left_semi").select("section_id"), "page-sections")
        few = lambda rows: rows if rows is None else rows.join(ids, "section_id", "left_semi")
        if not ix.keys:  # statistics stay those of the whole corpus; the stored ones, as frequencies of few postings are others
            ix = replace(ix, postings=few(ix.postings), bigrams=few(ix.bigrams)) if ix.buckets else ix
        asked = pages.select("qid").distinct()
        found = score(ix, self.queries.join(asked, "qid", "left_semi"), self.groups.join(asked, "qid", "left_semi"), *self.more)
        with by_page(pages):
            return kept(page_bests(found, 0.0).join(pages, ["qid", "path"], "left_semi"), "page-bests")

    def placed(self, pages: DataFrame) -> DataFrame:
        """``qid, path, section_id, score, place`` of the given pages that have ``min_score``: how many pages of the query come before.

        Each page of a query counts for all given ones that it comes before, by the number of these; counts are few rows.
        """
        own = self.of(pages).where(F.col("score") >= self.min_score).select("qid", "path", "section_id", "score")
        if self.scan:
            before = self.scan.before(own, self.min_score).withColumnRenamed("n", "place")
            return own.join(before, ["qid", "section_id"], "left").select("qid", "path", "section_id", "score", F.coalesce("place", F.lit(0)).alias("place"))
        nth = F.row_number().over(Window.partitionBy("qid").orderBy("score", "section_id"))
        own = kept(own.withColumn("nth", nth), "given")  # 1: the last of the given
        marks = own.groupBy("qid").agg(F.collect_list(F.struct("score", "section_id")).alias("marks"))
        rows = self.all(self.min_score).select("qid", F.struct("score", "section_id").alias("at")).join(sent(marks), "qid")
        counts = rows.select("qid", F.size(F.filter("marks", lambda m: m < F.col("at"))).alias("beyond")).groupBy("qid", "beyond").agg(F.count("*").alias("n"))
        with by_page(pages):
            counts = kept(counts, "beyond")
        before = own.join(counts, "qid").where(F.col("beyond") >= F.col("nth")).groupBy("qid", "path").agg(F.sum("n").alias("place"))
        return own.join(before, ["qid", "path"], "left").select("qid", "path", "section_id", "score", F.coalesce("place", F.lit(0)).alias("place"))


def find(index: Index, queries: DataFrame, synonyms: DataFrame, names: DataFrame | None = None, **how) -> DataFrame:
    """``qid, rank, section_id, path, score, matched, title_match`` and more: the best pages; ``how`` as in ``find_all``."""
    return find_all(index, queries, synonyms, names, **how)[0]


def outcomes(queries: DataFrame, groups: DataFrame, results: DataFrame) -> DataFrame:
    """``qid, confidence, uncertain, corrected`` of each query: the best score, whether a word was only guessed or unknown, and whether one was corrected."""
    of = groups.groupBy("qid").agg(F.max(~F.col("exact")).alias("uncertain"), F.max(F.col("correction").isNotNull()).alias("corrected"))
    best = results.groupBy("qid").agg(F.max("score").alias("confidence"))
    out = queries.select("qid").join(best, "qid", "left").join(of, "qid", "left")
    no = F.lit(False)
    return out.select("qid", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("uncertain", no).alias("uncertain"), (F.coalesce("corrected", no) & F.col("confidence").isNotNull()).alias("corrected"))


def unit(v: Column) -> Column:
    """A vector of length 1; zero stays zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def fuse(keyword: DataFrame, kept: DataFrame, meaning: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Reciprocal rank fusion of ``keyword`` (qid, path, section_id, score, place) and ``meaning``; ``kept`` are the pages that keywords alone show.

    Pages found by keywords keep their score; pages found by meaning alone get one that is never sure. Ties by path.
    """
    place = F.col("place") if "place" in keyword.columns else F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("section_id"))) - 1
    k = keyword.select("qid", "path", F.col("section_id").alias("ks"), "score", place.alias("kp"))
    m = meaning.select("qid", "path", F.col("section_id").alias("ms"), "similarity", F.col("place").alias("mp"))
    both = k.join(m, ["qid", "path"], "full").join(kept.select("qid", "path", F.lit(True).alias("kept")), ["qid", "path"], "left")
    fused = F.coalesce(1 / (RRF_K + F.col("kp")), F.lit(0.0)) + F.coalesce(SEMANTIC_WEIGHT / (RRF_K + F.col("mp")), F.lit(0.0))
    both = both.where(F.col("kept") | F.col("mp").isNotNull()).withColumn("fused", F.round(fused, 9))
    out = both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("fused"), "path")).cast("long")).where(F.col("rank") <= limit)
    return out.select("qid", "rank", "path", F.coalesce("ks", "ms").alias("section_id"), F.round(F.coalesce("score", SEMANTIC_SCORE * F.col("similarity")), 4).alias("score"), "fused")
