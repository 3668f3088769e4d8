"""Search over a small corpus made for each question: the pages whose titles fit it, with frequencies of their own.

All questions are searched in one plan. Titles are few words: the best of all titles that share a set of words are found once for
each set, and a question meets these alone, so that questions beside titles are never made. Candidate pages come from an index of titles; their sections are dealt to the
questions as pools, and lengths, document frequencies and guesses are counted by question (``index.of_pools``).
"""

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import distance, text as T, words as W
from quillspark.operators import blend, index as I, search as S
from quillspark.operators.index import sent
from quillspark.operators.store import kept

# Candidate pages, head start of the first two, lowest score, and the questions that a chapter on making or finding answers.
CANDIDATES, PRIORS, MIN_SCORE = 3, [1.5, 0.75], 1.0
HOW_TO = r"(?i)\b(make|craft|build|create|get|obtain|find|where|spawn)\b"
#: Titles of up to so many terms, and questions of up to so many that titles have, meet by sets of them; others by each term.
TITLE_TERMS, QUESTION_TERMS = 6, 12
HOW_TO_HEADINGS = "creation crafting obtaining construction recipe building natural generation spawning location"


def articles(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, path, title) that are articles; of pages with one title the first."""
    own = pages.where(W.is_article(F.col("title"), F.lit(""))).where(F.trim("title") != "")
    return own.groupBy("title").agg(F.min(F.struct("page_id", "path")).alias("p")).select("p.page_id", "p.path", "title")


def title_index(pages: DataFrame) -> I.Index:
    return I.build(pages.select(F.col("page_id").alias("section_id"), F.col("title").alias("text")))


def title_candidates(queries: DataFrame, pages: DataFrame, most: int = CANDIDATES, titles: I.Index | None = None) -> DataFrame:
    """``qid, place, page_id, path, title``: the pages whose titles fit best by BM25.

    Questions that find none are asked once more with their words put right after the titles' own (the nearest by edits, else one
    that goes on after it). Equal scores: the shorter title, then the first.
    """
    pages = kept(pages.select("page_id", "path", "title"), "articles")
    titles = titles or title_index(pages)
    titles = replace(titles, terms=kept(titles.terms, "title-terms"))
    queries = kept(queries.select("qid", "query"), "questions")
    weighted = kept(_weighted(titles, pages), "title-weights")
    heads = kept(_heads(weighted, most), "heads")
    by_title = lambda asked: _by_title(titles, weighted, heads, asked, most)
    first = kept(by_title(queries), "titles")
    lost = queries.join(first.select("qid").distinct(), "qid", "left_anti")
    words = kept(S.query_terms(lost), "lost")
    if words.isEmpty():
        return first
    near = S.typo_corrections(words, titles.terms).select("term", "guess")
    longer = S.prefix_matches(words.join(near, "term", "left_anti"), titles.terms)
    right = words.join(near.unionAll(longer), "term", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("guess", "word").alias("w")))).alias("ws"))
    again = right.select("qid", F.array_join("ws.w", " ").alias("query"))
    return first.unionByName(by_title(again))


def _weighted(titles: I.Index, pages: DataFrame) -> DataFrame:
    """``page_id, path, title, ts``: each title's terms with their BM25 weight, sorted."""
    rows = titles.postings.join(sent(titles.terms.select("term", "idf")), "term").join(titles.lengths, "section_id")
    rows = I.beside(rows, titles.corpus.select("avg_len"), [])
    s = I.bm25(F.col("tf"), F.col("length"), F.col("avg_len"), F.col("idf"))
    ts = rows.groupBy(F.col("section_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("term", s.alias("s")))).alias("ts"))
    return pages.join(ts, "page_id")


def _sets(array: str, kind: str, most: int) -> Column:
    """All sets of 1 to ``most`` of an array's items, in its order."""
    longer = lambda sets, x: F.transform(F.filter(sets, lambda s: F.size(s) < most), lambda s: F.concat(s, F.array(x)))
    none = F.array(F.array().cast(f"array<{kind}>"))
    return F.filter(F.aggregate(array, none, lambda sets, x: F.concat(sets, longer(sets, x))), lambda s: F.size(s) > 0)


def _heads(weighted: DataFrame, most: int) -> DataFrame:
    """``set, page_id, path, title, score``: of each set of words the best titles that have them all, by these words alone.

    A title of a question's best is among the best of the very set of words that it shares with the question: what comes before
    it there has these words too, so it comes before it in the question as well. Weights are above 0.
    """
    rows = weighted.where(F.size("ts") <= TITLE_TERMS).withColumn("s", F.explode(_sets("ts", "struct<term:string,s:double>", TITLE_TERMS)))
    total = F.aggregate("s", F.lit(0.0), lambda n, t: n + t["s"])
    rows = rows.select(F.array_join("s.term", " ").alias("set"), "page_id", "path", "title", F.round(total, 4).alias("score"))
    order = Window.partitionBy("set").orderBy(F.desc("score"), F.length("title"), "page_id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")  # tasks cut before the exchange


def _by_title(titles: I.Index, weighted: DataFrame, heads: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    known = S.query_terms(queries).select("qid", "term").join(titles.terms.select("term"), "term", "left_semi")
    asked = kept(known.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("ts")), "asked-titles")
    few = F.size("ts") <= QUESTION_TERMS
    sets = asked.where(few).select("qid", F.explode(_sets("ts", "string", TITLE_TERMS)).alias("s")).select("qid", F.array_join("s", " ").alias("set"))
    shown = ["qid", "page_id", "path", "title"]
    by_set = sets.join(heads, "set").select(*shown, "score")
    each = lambda rows: rows.select("page_id", "path", "title", F.inline("ts"))
    terms = lambda rows: rows.select("qid", F.explode("ts").alias("term"))
    long = F.size("ts") > TITLE_TERMS
    plain = each(weighted.where(long)).join(terms(asked), "term").unionByName(each(weighted.where(~long)).join(terms(asked.where(~few)), "term"))
    by_term = plain.groupBy(*shown).agg(F.round(F.sum("s"), 4).alias("score"))
    scored = by_set.unionByName(by_term).groupBy(*shown).agg(F.max("score").alias("score"))  # of a title's sets the whole one
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.length("title"), "page_id")
    rows = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return rows.select("qid", F.col("place").cast("long").alias("place"), "page_id", "path", "title")


def similar(a: Column, b: Column) -> Column:
    """Equal, one the start of the other, or a small typo, of words of four letters or more: one edit below eight letters, else two."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    near = (longer - shorter <= 2) & (F.levenshtein(a, b, 4) >= 0)
    typo = F.when(near, distance.alignment_column(a, b) <= F.when(longer < 8, 1).otherwise(2)).otherwise(F.lit(False))
    return (a == b) | ((shorter >= 4) & (F.startswith(a, b) | F.startswith(b, a) | typo))


def titled(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``qid`` of questions that name their ``titles`` (qid, title): each word of the title is like one of the question."""
    of_title = T.terms(titles.select("qid", "title"), "title").select("qid", "title", F.col("term").alias("t")).distinct()
    asked = T.terms(queries.select("qid", "query"), "query").select("qid", F.col("term").alias("a")).distinct()
    held = of_title.join(asked, "qid").where(similar(F.col("t"), F.col("a"))).select("qid", "title", "t").distinct().groupBy("qid", "title").agg(F.count("*").alias("held"))
    sizes = of_title.groupBy("qid", "title").agg(F.count("*").alias("size"))
    return held.join(sizes, ["qid", "title"]).where("held = size").select("qid").distinct()


def _hints(queries: DataFrame) -> DataFrame:
    return queries.where(F.col("query").rlike(HOW_TO)).select("qid", F.explode(T.stems(HOW_TO_HEADINGS.split())).alias("hint"))


def _pools(candidates: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``qid, path`` of the candidates that have sections, and ``qid, path, prior``; pages without sections have no place among the priors."""
    there = sections.select("path").join(sent(candidates.select("path").distinct(), I.ASKED_ROWS), "path", "left_semi").distinct()
    rows = kept(candidates.select("qid", "path", "place").join(there, "path"), "pool-pages")
    order = Window.partitionBy("qid").orderBy("place")
    paths = rows.groupBy("qid", "path").agg(F.min("place").alias("place")).withColumn("n", F.row_number().over(order))
    prior = F.when(F.col("n") <= len(PRIORS), F.element_at(F.array(*map(F.lit, PRIORS)), F.least(F.col("n"), F.lit(len(PRIORS))))).otherwise(0.0)
    return rows.select("qid", "path"), paths.select("qid", "path", prior.alias("prior"))


def live_search(questions: DataFrame, sections: DataFrame, pages: DataFrame, synonyms: dict[str, str] = {}, limit: int = 2) -> DataFrame:
    """``qid, rank, section_id, path, score, matched, title_match, titled``: the best sections among each question's candidate pages.

    ``questions``: qid, query, and ``check`` (boolean, may be left out): only a first page that the question names counts then.
    ``sections``: as for an index, ``path`` is the page's. ``pages``: page_id, path, title. ``titled``: the question names its
    first candidate. Questions without a word that counts find nothing; null questions count as empty.
    """
    spark = questions.sparkSession
    check = F.coalesce("check", F.lit(False)) if "check" in questions.columns else F.lit(False)
    q = questions.select("qid", F.coalesce("query", F.lit("")).alias("asked"), check.alias("check"))
    q = q.withColumn("query", W.keywords(F.col("asked"), synonyms, T.STOPWORDS)).where(F.size(T.tokens(F.col("query"))) > 0)
    q = kept(q, "live")
    pages = articles(pages)
    candidates = kept(title_candidates(q, pages), "candidates")
    named = kept(titled(q, candidates.where("place = 1").select("qid", "title")), "named")
    open_ = q.join(named.withColumn("titled", F.lit(True)), "qid", "left").withColumn("titled", F.coalesce("titled", F.lit(False)))
    use = candidates.join(open_.select("qid", "check", "titled"), "qid").where(~F.col("check") | (F.col("titled") & (F.col("place") == 1)))
    sections = sections.withColumn("vanilla", F.lit(True))
    pool, priors = _pools(use, sections)
    words = spark.createDataFrame(list(synonyms.items()), "word string, synonym string")
    index = I.of_pools(sections, pool, by="path")
    asked = q.select("qid", "query")
    found = S.find(index, asked, words, limit=limit, min_score=MIN_SCORE, priors=kept(priors, "priors"), hints=_hints(q.select("qid", F.col("asked").alias("query"))))
    return found.join(open_.select("qid", F.col("titled").alias("names_page")), "qid").select("qid", "rank", "section_id", "path", "score", "matched", "title_match", F.col("names_page").alias("titled"))


def named_pages(questions: DataFrame, names: DataFrame, sections: DataFrame, pages: DataFrame, synonyms: dict[str, str] = {}, ambiguous: list[str] = ()) -> DataFrame:
    """``qid, name, section_id, path, score, matched``: the best section of the page that is named as the thing a question names.

    The page's title has the same words as the name. Its sections are searched with the question, and if nothing is found with
    the name itself.
    """
    spark = questions.sparkSession
    things = kept(blend.named_thing(questions, names, ambiguous), "things")
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(T.tokens(F.col(c)))), " ")
    exact = articles(pages).withColumn("key", key("title")).groupBy("key").agg(F.min(F.struct("page_id", "path", "title")).alias("p"))
    page = things.withColumn("key", key("name")).join(exact, "key").select("qid", "name", "p.path", F.lit(1).cast("long").alias("place"))
    sections = sections.withColumn("vanilla", F.lit(True))
    pool, priors = _pools(page, sections)
    priors = kept(priors, "priors")
    words = spark.createDataFrame(list(synonyms.items()), "word string, synonym string")
    index = I.of_pools(sections, pool, by="path")
    mine = kept(questions.join(page.select("qid", "name"), "qid"), "named")
    ask = lambda q: S.find(index, q, words, limit=1, min_score=0.0, priors=priors, hints=_hints(mine.select("qid", "query")))
    first = kept(ask(mine.select("qid", W.keywords(F.col("query"), synonyms, T.STOPWORDS).alias("query"))), "first")
    rest = mine.join(first.select("qid"), "qid", "left_anti").select("qid", F.col("name").alias("query"))
    found = first.unionByName(ask(rest)) if not rest.isEmpty() else first
    return found.join(page.select("qid", "name"), "qid").select("qid", "name", "section_id", "path", "score", "matched")


def with_named(results: DataFrame, named: DataFrame, titles: DataFrame, total: int = 3) -> DataFrame:
    """``results`` (qid, rank, source, section_id, path, score, title_match; source "b" is the live one) with each named page put in.

    It goes first, or second behind a page of the first source whose title holds all words of the name; a question that has a
    live page of that title already stays as it is. ``titles``: source, path, title.
    """
    shown = results.join(titles.select("source", "path", "title"), ["source", "path"], "left")
    of = named.select("qid", "name", F.col("path").alias("named_path"))
    there = shown.join(of, "qid").where((F.col("source") == "b") & (F.lower("title") == F.lower("name"))).select("qid").distinct()
    add = named.join(there, "qid", "left_anti")
    lead = shown.where("rank = 1 and source = 'a'").join(of, "qid").where((F.size(F.array_except(T.tokens(F.col("name")), T.tokens(F.col("title")))) == 0)).select("qid", F.lit(True).alias("behind"))
    new = add.join(lead, "qid", "left").select("qid", F.when(F.col("behind"), 1.5).otherwise(0.5).alias("at"), F.lit("b").alias("source"), "section_id", "path", "score", F.lit(True).alias("title_match"))
    gone = add.select("qid", "path", F.lit("b").alias("source"))
    old = results.join(gone, ["qid", "path", "source"], "left_anti").select("qid", F.col("rank").cast("double").alias("at"), "source", "section_id", "path", "score", "title_match")
    order = Window.partitionBy("qid").orderBy("at")
    return old.unionByName(new).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= total).drop("at")
