"""Queries of the retrieval core."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import distance, text as T
from quillspark.operators import index as I, search as S, vectors as V
from quillspark.operators.index import sent
from quillspark.plans.common import (
    ALL_QUESTIONS_SQL, BM25_SQL, MESSAGES_SQL, QTERMS_SQL, QUESTIONS_SQL, SECTIONS_SQL, all_questions, counted_index, index_sql, messages, query, questions, section_index, sections, table, text_index, text_sections,
)

# Abbreviations as the queries use them; any (word, synonym) table can take their place.
SYNONYMS = [("the", "and"), ("thon", "ther erand"), ("tp", "teleport"), ("ther", "thand the"), ("er", "is nd"), ("src1", "src2")]


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNONYMS, "word string, synonym string")


SYNONYMS_SQL = "syn(w, synonym) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + ")"


@query(f"WITH {index_sql()} SELECT n, round(avg_len, 6) AS avg_len FROM c")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(text_sections(spark, sf_dir)).corpus.select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {index_sql()} SELECT term, df, round(idf, 6) AS idf FROM t")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(text_sections(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {index_sql(True)} SELECT section_id, term, tf FROM p")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.postings(I.cleaned(sections(spark, sf_dir)))


@query(f"WITH {index_sql()} SELECT pair, df, round(idf, 6) AS idf FROM bt")
def bigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(text_sections(spark, sf_dir), True).pairs.select("pair", "df", F.round("idf", 6).alias("idf"))


@query(
    f"""WITH f AS (SELECT doc_id, text FROM documents), w AS ({T.sql_terms('f', 'doc_id', 'text')}),
n AS (SELECT term, word, count(*) AS n, min((doc_id, pos)) AS first FROM w GROUP BY ALL)
SELECT term, word AS display FROM n QUALIFY row_number() OVER (PARTITION BY term ORDER BY n DESC, first, word) = 1"""
)
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.display_forms(text_sections(spark, sf_dir))


@query(
    f"""WITH {index_sql()}, v AS (SELECT term, df FROM t WHERE len(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+'))
SELECT left(term, 1) AS initial, term, df FROM v QUALIFY row_number() OVER (PARTITION BY left(term, 1) ORDER BY df DESC, term) <= 20"""
)
def vocab_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent words of each initial."""
    vocab = I.vocabulary(I.build(text_sections(spark, sf_dir)).terms).withColumn("initial", F.substring("term", 1, 1))
    w = Window.partitionBy("initial").orderBy(F.desc("df"), "term")
    return vocab.withColumn("nth", F.row_number().over(w)).where("nth <= 20").select("initial", "term", "df")


@query(
    f"""WITH f AS (SELECT doc_id, text FROM documents), w AS ({T.sql_terms('f', 'doc_id', 'text')})
SELECT d.doc_id, count(term) AS n_terms, count(DISTINCT term) AS n_distinct FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id"""
)
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = T.terms(docs, "text").groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_terms"), F.count("*").alias("n_distinct"))
    return docs.select("doc_id").join(counted, "doc_id", "left").fillna(0)


@query(f"WITH {MESSAGES_SQL}, w AS ({T.sql_terms('m', 'conv_id', 'text', None)}) SELECT word, term, count(*) AS n FROM w GROUP BY ALL")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.terms(messages(spark, sf_dir), "text", None).groupBy("word", "term").agg(F.count("*").alias("n"))


_HINTS = {k: T.sql_stems(v.split()) for k, v in (("w", T.WHERE_HEADINGS), ("o", T.OBTAIN_HEADINGS), ("l", T.LIST_HEADINGS))}


def _hints_sql(asked: str, folded: str) -> str:
    lists = {k: f"list_sort(list_distinct([{v}]))" for k, v in _HINTS.items()}
    return (
        f"list_sort(list_distinct(list_concat(list_concat(CASE WHEN list_has_any({asked}, [{T.sql_list(T.WHERE_WORDS)}]) THEN {lists['w']} ELSE [] END, "
        f"CASE WHEN list_has_any({asked}, [{T.sql_list(T.OBTAIN_WORDS)}]) THEN {lists['o']} ELSE [] END), "
        f"CASE WHEN regexp_matches({folded}, '{T.LIST_QUESTION}') THEN {lists['l']} ELSE [] END)))"
    )


HINT_MESSAGES = ["where do I find it", "how do I craft this", "which kinds are there", "what drops are there", "tell me", "an overview of every recipe"]
_HINT_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(HINT_MESSAGES))


@query(
    f"""WITH {MESSAGES_SQL}, a AS (SELECT conv_id, turn, text FROM m UNION ALL SELECT -1, * FROM (VALUES {_HINT_VALUES}))
SELECT conv_id, turn, array_to_string({_hints_sql("regexp_extract_all(" + T.sql_fold('text') + ", '[a-z]+')", T.sql_fold('text'))}, ' ') AS hints FROM a"""
)
def question_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, i, t) for i, t in enumerate(HINT_MESSAGES)], "conv_id long, turn long, text string")
    return messages(spark, sf_dir).unionByName(extra).select("conv_id", "turn", F.array_join(T.question_hints(F.col("text")), " ").alias("hints"))


def _bm25_sql(limit: int) -> str:
    return f"""WITH {index_sql()}, {QUESTIONS_SQL}, {QTERMS_SQL},
s AS (SELECT qid, p.section_id, round(sum({BM25_SQL}), 4) AS score FROM qt JOIN p USING (term) JOIN t USING (term) JOIN l ON l.section_id = p.section_id, c GROUP BY qid, p.section_id),
r AS (SELECT qid, section_id AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section_id DESC) AS rank FROM s)
SELECT * FROM r WHERE rank <= {limit}"""


@query(_bm25_sql(3))
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the three best documents for each benchmark question."""
    found = S.plain_search(text_index(spark, sf_dir), questions(spark, sf_dir))
    return found.select("qid", F.col("section_id").alias("doc_id"), "score", "rank")


def containing(docs: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """``qid, doc_id`` of passages that stand in a document: an equi-join on a run of words inside the passage, then the whole is compared.

    The run leaves out the passage's first word and starts at its second, as a document may hold the first one cut. Shorter
    passages are looked for by their longest inner run, and those of under three words in all documents.
    """
    run = lambda ws, n: F.array_join(F.slice(ws, F.lit(2), n), " ")
    ws = F.split(F.trim("passage"), r"\s+")
    n = F.least(F.lit(words), F.size(ws) - 2)
    p = passages.where("passage <> ''").withColumn("n", n).withColumn("run", F.when(n > 0, run(ws, n)))
    sizes = [r["n"] for r in p.select("n").where("n > 0").distinct().collect()]  # up to ``words`` of them
    out = docs.join(sent(p.where("n <= 0")), F.contains("text", "passage")).select("qid", "doc_id")
    of = F.split("text", r"\s+")
    for k in sizes:
        keys = sent(p.where(F.col("n") == k).select("qid", "passage", "run"))
        n, runs = F.size(of), of
        for j in range(1, k):  # neighbours are joined side by side: a lambda that looked into the array would split the text for each of its words
            runs = F.zip_with(F.slice(runs, F.lit(1), F.greatest(n - j, F.lit(0))), F.slice(of, F.lit(j + 1), F.greatest(n - j, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        near = docs.select("doc_id", F.explode(runs).alias("run")).join(keys, "run").select("doc_id", "qid", "passage").distinct()
        out = out.unionAll(docs.join(sent(near), "doc_id").where(F.contains("text", "passage")).select("qid", "doc_id"))
    return out.distinct()


@query(
    f"""WITH r AS ({_bm25_sql(3)}),
truth AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
e AS (SELECT b.item_id AS qid, min(CASE WHEN truth.doc_id IS NOT NULL THEN rank END) AS place FROM benchmark b LEFT JOIN r ON r.qid = b.item_id LEFT JOIN truth ON truth.qid = r.qid AND truth.doc_id = r.doc_id
  WHERE b.item_id IN (SELECT qid FROM truth) GROUP BY b.item_id)
SELECT count(*) AS questions, count(*) FILTER (place = 1) AS hit1, count(*) FILTER (place <= 3) AS hit3, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr FROM e"""
)
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hit@1, hit@3 and mean reciprocal rank: whole benchmark items against the documents that contain them."""
    found = S.plain_search(text_index(spark, sf_dir), questions(spark, sf_dir)).select("qid", F.col("section_id").alias("doc_id"), "rank")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    whole = containing(table(spark, sf_dir, "documents").select("doc_id", "text"), items)
    ranks = found.join(whole, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("place"))
    each = whole.select("qid").distinct().join(ranks, "qid", "left")
    return each.agg(
        F.count("*").alias("questions"), F.count_if(F.col("place") == 1).alias("hit1"), F.count_if(F.col("place") <= 3).alias("hit3"),
        F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr"),
    )


def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term``: words of the projects' names, which are never corrected to others."""
    return T.terms(table(spark, sf_dir, "documents").select("source").distinct(), "source").select("term").distinct()


_LIMIT = "(CASE WHEN len(un.term) < 8 THEN 1 ELSE 2 END)"
_SWAP = " OR ".join(
    f"(i + {o} >= 1 AND substr(guess, i + {o}, 2) = substr(un.term, i + 1, 1) || substr(un.term, i, 1) AND damerau_levenshtein(left(un.term, i - 1), left(guess, i + {o} - 1)) + damerau_levenshtein(substr(un.term, i + 2), substr(guess, i + {o} + 2)) <= 1)"
    for o in (-1, 0, 1)
)


def guess_sql(key: str = "", p: str = "") -> str:
    """CTEs ty and pf: the nearest word of t for terms un, by edits and swaps of neighbours that nothing else touches; and one that goes on after it.

    ``key``: a column (with a comma) that tells several corpora apart; ``p``: what all names start with.
    """
    same = f"AND un.{key.strip(', ')} = v.{key.strip(', ')}" if key else ""
    return f"""{p}v AS MATERIALIZED (SELECT {key} term AS guess, df FROM {p}t WHERE len(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+')),
{p}cd AS (SELECT {'un.' + key if key else ''} un.term, guess, df, damerau_levenshtein(un.term, guess) AS dl, levenshtein(un.term, guess) AS lv FROM {p}un AS un JOIN {p}v AS v ON abs(len(un.term) - len(guess)) <= {_LIMIT} AND damerau_levenshtein(un.term, guess) <= {_LIMIT} {same} WHERE len(un.term) >= 4 AND NOT regexp_full_match(un.term, '[0-9]+')),
{p}ty AS (SELECT {key} term, guess, dist FROM (SELECT *, CASE WHEN dl <= 1 THEN dl WHEN lv <= 2 OR len(list_filter(range(1, len(un.term)), lambda i: {_SWAP})) > 0 THEN 2 ELSE 3 END AS dist FROM {p}cd AS un) un
  WHERE dist <= {_LIMIT} QUALIFY row_number() OVER (PARTITION BY {key} term ORDER BY dist, df DESC, guess) = 1),
{p}pf AS (SELECT {'un.' + key if key else ''} un.term, guess FROM {p}un AS un JOIN {p}v AS v ON starts_with(guess, un.term) AND guess <> un.term {same} WHERE len(un.term) >= 4 QUALIFY row_number() OVER (PARTITION BY {'un.' + key if key else ''} un.term ORDER BY df DESC, guess) = 1)"""


NAMES_SQL = f"nt AS (SELECT DISTINCT term FROM ({T.sql_terms('(SELECT DISTINCT source FROM documents)', 'source', 'source')}))"
NO_NAMES_SQL = "nt AS (SELECT NULL::VARCHAR AS term WHERE false)"


def alternatives_sql(synonyms_sql: str = SYNONYMS_SQL, names_sql: str = NAMES_SQL, key: str = "") -> str:
    """CTEs gg and al: what each word of the questions qt may stand for; with ``key`` ("qid,") in a corpus of each question's own."""
    own = "AND t.qid = qt.qid" if key else ""
    also = lambda x: f"AND {x}.qid = g1.qid" if key else ""
    return f"""{synonyms_sql}, st AS (SELECT w, pos AS spot, term AS s FROM ({T.sql_terms('syn', 'w', 'synonym')})),
us AS (SELECT qt.qid, qt.term, list(s ORDER BY spot) AS found FROM qt JOIN st ON st.w = qt.word JOIN t ON t.term = s {own} WHERE s <> qt.term GROUP BY qt.qid, qt.term),
{names_sql},
g AS (SELECT qt.qid, qt.pos, qt.word, qt.term, t.term IS NOT NULL AS known, us.found, nt.term IS NOT NULL AS name FROM qt LEFT JOIN t ON t.term = qt.term {own} LEFT JOIN us ON us.qid = qt.qid AND us.term = qt.term LEFT JOIN nt ON nt.term = qt.term),
g1 AS MATERIALIZED (SELECT *, known OR found IS NOT NULL AS exact FROM g WHERE known OR found IS NOT NULL OR name OR NOT (word IN ({T.sql_list(S.WHAT_TYPOS)})
  OR (len(word) >= 4 AND ({' OR '.join(f"damerau_levenshtein(word, '{x}') <= 1" for x in S.QUESTION_WORDS)})))),
un AS MATERIALIZED (SELECT DISTINCT {key} term FROM g1 WHERE NOT exact), {guess_sql(key)},
g2 AS (SELECT g1.*, coalesce(ty.guess, pf.guess) AS maybe, CASE WHEN ty.guess IS NOT NULL THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS gw FROM g1 LEFT JOIN ty ON ty.term = g1.term {also('ty')} LEFT JOIN pf ON pf.term = g1.term {also('pf')}),
gg AS (SELECT *, CASE WHEN NOT exact AND (NOT name OR starts_with(maybe, term) OR starts_with(term, maybe)) THEN maybe END AS guess FROM g2),
al AS (SELECT qid, pos, 0 AS alt, term, 1.0::DOUBLE AS weight FROM gg WHERE known
  UNION ALL SELECT qid, pos, 1, unnest(found), CASE WHEN known THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END FROM gg WHERE found IS NOT NULL
  UNION ALL SELECT qid, pos, 2, guess, gw FROM gg WHERE guess IS NOT NULL)"""


#: Terms with their frequencies, from each document's distinct words.
_TERMS_SQL = f"t AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT section_id, term FROM ({T.sql_terms('(SELECT section_id, unnest([text, page_title, heading, path, meta]) AS v FROM sec)', 'section_id', 'v')})) GROUP BY term)"


@query(
    f"""WITH {SECTIONS_SQL}, {_TERMS_SQL}, {ALL_QUESTIONS_SQL}, {QTERMS_SQL}, {alternatives_sql()}
SELECT qid, pos, word, term, exact, (known::INT + (found IS NOT NULL)::INT + (guess IS NOT NULL)::INT)::BIGINT AS n_alternatives, coalesce(array_to_string(found, ' '), '') AS synonym, coalesce(guess, '') AS correction FROM gg"""
)
def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.analyze(section_index(spark, sf_dir, "terms"), all_questions(spark, sf_dir), synonyms(spark), project_names(spark, sf_dir))
    syn = F.filter("alternatives", lambda a: a["weight"].isin(S.SYNONYM_WEIGHT, S.SYNONYM_ONLY_WEIGHT))
    return got.select(
        "qid", F.col("pos").cast("long").alias("pos"), "word", "term", "exact", F.size("alternatives").cast("long").alias("n_alternatives"),
        F.coalesce(F.array_join(F.get(syn, F.lit(0))["terms"], " "), F.lit("")).alias("synonym"), F.coalesce("correction", F.lit("")).alias("correction"),
    )


def _set_sql(name: str, column: str, stop: bool) -> str:
    return f"{name} AS (SELECT section_id, list_distinct(list(term)) AS x FROM ({T.sql_terms('sec', 'section_id', column, T.STOPWORDS if stop else None)}) GROUP BY section_id)"


_TECHNICAL = T.sql_stems(S.TECHNICAL_WORDS)
def score_sql(keyed: bool = False, hints: str = "[]::VARCHAR[]", least: float = 2.0, limit: int = 3) -> str:
    """CTEs up to fin (results of every question), from sec, p, l, bg, q, qt, gg, al and statistics t, bt, c.

    ``keyed``: all statistics are by qid, and pool (qid, section_id) and prior (qid, path, prior) are there; sections are of the other wiki then.
    """
    vanilla = "true" if keyed else "false"
    pool_p, own_t = ("JOIN pool ON pool.qid = al.qid AND pool.section_id = p.section_id", "AND t.qid = al.qid") if keyed else ("", "")
    pool_b, own_b = ("JOIN pool ON pool.qid = pr.qid AND pool.section_id = bg.section_id", "AND bt.qid = pr.qid") if keyed else ("", "")
    corpus = "JOIN c ON c.qid = al.qid" if keyed else ", c"
    prior, prior_join = ("+ coalesce(prior.prior, 0)", "LEFT JOIN prior ON prior.qid = x.qid AND prior.path = x.path") if keyed else ("", "")
    return f"""e AS (SELECT al.qid, al.pos, al.alt, p.section_id, any_value(al.weight) * sum({BM25_SQL}) AS s FROM al JOIN p USING (term) {pool_p} JOIN t ON t.term = al.term {own_t} JOIN l ON l.section_id = p.section_id {corpus} GROUP BY al.qid, al.pos, al.alt, p.section_id),
b AS (SELECT qid, section_id, pos, max(s) AS s FROM e GROUP BY qid, section_id, pos HAVING max(s) > 0),
wd AS (SELECT qid, section_id, sum(s) AS words, count(*) AS matched FROM b GROUP BY qid, section_id),
inf AS (SELECT qid, count(DISTINCT pos) AS active, list_distinct(list(term)) AS asked FROM al GROUP BY qid),
hi AS (SELECT qid, list_concat({_hints_sql("regexp_extract_all(" + T.sql_fold('query') + ", '[a-z]+')", T.sql_fold('query'))}, {hints}) AS hints FROM q),
{_set_sql('tt', 'page_title', True)}, {_set_sql('ht', 'heading', True)}, {_set_sql('hh', 'heading', False)}, {_set_sql('th', 'page_title', False)},
fo AS (SELECT section_id, list_distinct(list(term)) AS x FROM ({T.sql_terms('sec', 'section_id', "translate(split_part(path, '/', 1), '_', ' ')")}) GROUP BY section_id),
fe AS (SELECT *, CASE WHEN home THEN list_distinct(list_concat(own_title, folder_terms0)) ELSE own_title END AS title_terms, CASE WHEN home AND NOT {vanilla} THEN list_concat(own_hints, [{_HINTS['l']}]) ELSE own_hints END AS hint_targets, CASE WHEN home AND NOT {vanilla} THEN folder_terms ELSE [] END AS project_terms
  FROM (SELECT sec.*, path LIKE '%/home' OR lower(page_title) IN ({T.sql_list(S.GENERIC_TITLES)}) AS home, list_filter(coalesce(tt.x, []), lambda v: v NOT IN ({T.sql_list(S.GENERIC_TITLES)})) AS own_title, CASE WHEN heading <> page_title THEN coalesce(ht.x, []) ELSE [] END AS heading_terms,
  list_concat(coalesce(hh.x, []), list_filter(coalesce(th.x, []), lambda v: v IN ({_HINTS['l']}))) AS own_hints, coalesce(fo.x, []) AS folder_terms0, CASE WHEN {vanilla} THEN [] ELSE coalesce(fo.x, []) END AS folder_terms
  FROM sec LEFT JOIN tt USING (section_id) LEFT JOIN ht USING (section_id) LEFT JOIN hh USING (section_id) LEFT JOIN th USING (section_id) LEFT JOIN fo USING (section_id))),
al0 AS (SELECT qid, pos, CASE WHEN known THEN term WHEN found IS NOT NULL THEN found[1] ELSE guess END AS front, CASE WHEN known THEN term WHEN found IS NOT NULL THEN found[-1] ELSE guess END AS back FROM gg WHERE exact OR guess IS NOT NULL),
pr AS (SELECT qid, back AS one, lead(front) OVER (PARTITION BY qid ORDER BY pos) AS two FROM al0),
allf AS (SELECT DISTINCT unnest(folder_terms) AS v FROM fe),
pb AS (SELECT pr.qid, bg.section_id, sum(1.5::DOUBLE * bt.idf * bg.tf * 2.5::DOUBLE / (bg.tf + 1.5::DOUBLE)) AS pairs FROM pr JOIN bg ON bg.pair = pr.one || ' ' || pr.two {pool_b} JOIN bt ON bt.pair = bg.pair {own_b} JOIN fe ON fe.section_id = bg.section_id
  WHERE two IS NOT NULL AND (one NOT IN (SELECT v FROM allf) OR list_contains(folder_terms, one)) AND (two NOT IN (SELECT v FROM allf) OR list_contains(folder_terms, two)) GROUP BY pr.qid, bg.section_id),
x AS (SELECT wd.qid, wd.section_id, fe.path, matched, len(title_terms) > 0 AND list_has_all(asked, title_terms) AS tm, len(heading_terms) > 0 AND list_has_all(asked, heading_terms) AS hm,
  len(project_terms) > 0 AND list_has_all(project_terms, asked) AS pm, list_has_any(folder_terms, asked) AS fm, list_has_any(hint_targets, hints) AS hint, (words + coalesce(pairs, 0)) * sqrt(matched::DOUBLE / active) AS base,
  (CASE WHEN NOT list_has_any(asked, [{T.sql_list(S.CHANGELOG_WORDS)}]) AND lower(path) LIKE '%changelog%' THEN 0.5::DOUBLE ELSE 1 END)
  * (CASE WHEN NOT list_has_any(asked, [{_TECHNICAL}]) AND lower(heading) IN ({T.sql_list(S.TECHNICAL_HEADINGS)}) THEN 0.4::DOUBLE ELSE 1 END) AS damp
  FROM wd JOIN inf USING (qid) JOIN hi USING (qid) JOIN fe ON fe.section_id = wd.section_id LEFT JOIN pb ON pb.qid = wd.qid AND pb.section_id = wd.section_id),
sc AS (SELECT x.qid, section_id, x.path, matched, tm, hm, hint, pm, round((base + tm::INT * 2 + (tm AND fm)::INT * 2 + hm::INT * 1 + hint::INT * 2.5::DOUBLE + pm::INT * 3) * damp {prior}, 4) AS score FROM x {prior_join}),
pg AS MATERIALIZED (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY qid, path ORDER BY score DESC, section_id) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section_id DESC) AS rank FROM pg WHERE score >= {least}),
ct AS MATERIALIZED (SELECT * FROM rk WHERE rank <= {limit} QUALIFY score >= max(score) OVER (PARTITION BY qid) * 0.35::DOUBLE),
tw AS (SELECT qid, any_value(parent) AS parent, max(score) AS top FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent FROM ct WHERE rank <= 2) JOIN hi USING (qid)
  WHERE list_has_any(hints, [{_HINTS['l']}]) GROUP BY qid HAVING count(*) = 2 AND count(DISTINCT parent) = 1 AND NOT bool_or(tm AND rank = 1)),
ow AS (SELECT regexp_replace(path, '/[^/]*$', '') AS parent, min(section_id) AS section_id FROM fe WHERE path LIKE '%/overview' OR contains(lower(page_title), 'overview') GROUP BY 1),
bf AS (SELECT qid, section_id, top FROM tw JOIN ow USING (parent)),
bh AS (SELECT qid, fe.section_id, top FROM tw JOIN inf USING (qid) JOIN fe ON fe.home AND NOT {vanilla} AND split_part(fe.path, '/', 1) = split_part(tw.parent, '/', 1) AND len(heading_terms) > 0 AND list_has_all(asked, heading_terms)
  WHERE qid NOT IN (SELECT qid FROM bf) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY len(heading_terms) DESC, fe.section_id) = 1),
fr AS (SELECT o.qid, o.section_id, fe.path, round(top + 0.01::DOUBLE, 4) AS score, coalesce(pg.matched, 0) AS matched, (len(title_terms) > 0 AND list_has_all(asked, title_terms)) OR (len(heading_terms) > 0 AND list_has_all(asked, heading_terms)) AS title_match, len(title_terms) > 0 AND list_has_all(asked, title_terms) AS tm, list_has_any(hint_targets, hints) AS hint, len(project_terms) > 0 AND list_has_all(project_terms, asked) AS pm, 0 AS rank
  FROM (SELECT * FROM bf UNION ALL SELECT * FROM bh) o JOIN fe USING (section_id) JOIN inf USING (qid) JOIN hi USING (qid) LEFT JOIN pg ON pg.qid = o.qid AND pg.section_id = o.section_id),
ov AS (SELECT * FROM fr UNION ALL SELECT qid, section_id, path, score, matched, tm OR hm, tm, hint, pm, rank FROM ct WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.qid = ct.qid AND fr.path = ct.path)),
fin AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ov.rank) AS place FROM ov)"""


FULL_SCORE_SQL = f"{index_sql(True)}, {ALL_QUESTIONS_SQL}, {QTERMS_SQL}, {alternatives_sql()},\n{score_sql()}"


@query(f"WITH {FULL_SCORE_SQL} SELECT qid, place AS rank, section_id, score, matched, title_match FROM fin WHERE place <= 3")
def full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search as it runs by default: synonyms, guesses with protected names, pairs, coverage, bonuses, damping, cutoff and overview pages."""
    ix = counted_index(spark, sf_dir)
    return S.find(ix, all_questions(spark, sf_dir), synonyms(spark), project_names(spark, sf_dir)).select("qid", "rank", "section_id", "score", "matched", "title_match")


_MUTANTS = "mu AS (SELECT DISTINCT left(w, len(w) - 2) || right(w, 1) || substr(w, len(w) - 1, 1) AS term FROM (SELECT unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z]+')) AS w FROM benchmark) WHERE len(w) >= 4)"


def mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of four letters or more with their last two swapped."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z]+"), F.lit(0))).alias("w")).where(F.length("w") >= 4)
    n = F.length("w")
    return w.select(F.concat(F.substring("w", F.lit(1), n - 2), F.substring("w", n, F.lit(1)), F.substring("w", n - 1, F.lit(1))).alias("term")).distinct()


@query(f"WITH {index_sql()}, {_MUTANTS}, un AS MATERIALIZED (SELECT term FROM mu WHERE term NOT IN (SELECT term FROM t)), {guess_sql()} SELECT term, guess, dist::INTEGER AS dist FROM ty")
def typo_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every length: one edit, two from eight letters."""
    terms = text_index(spark, sf_dir, "terms").terms
    return S.typo_corrections(mutants(spark, sf_dir).join(terms, "term", "left_anti"), terms)


@query(
    f"""WITH {index_sql()}, un AS MATERIALIZED (SELECT DISTINCT left(term, len(term) // 2 + 1) AS term FROM t WHERE len(term) >= 6 AND left(term, len(term) // 2 + 1) NOT IN (SELECT term FROM t)),
v AS MATERIALIZED (SELECT term AS guess, df FROM t WHERE len(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+'))
SELECT un.term, guess FROM un JOIN (SELECT guess, df, unnest(range(4, len(guess))) AS k FROM v) v ON left(guess, k) = un.term QUALIFY row_number() OVER (PARTITION BY un.term ORDER BY df DESC, guess) = 1"""
)
def prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of every word of six letters or more that are no words themselves."""
    terms = text_index(spark, sf_dir, "terms").terms
    starts = terms.where(F.length("term") >= 6).select(F.expr("left(term, length(term) div 2 + 1)").alias("term")).distinct()
    return S.prefix_matches(starts.join(terms, "term", "left_anti"), terms)


@query(
    f"""WITH {MESSAGES_SQL}, w AS (SELECT DISTINCT unnest(regexp_extract_all({T.sql_fold('text')}, '[a-z]+')) AS word FROM m
  UNION SELECT unnest(['wher', 'shuold', 'waht', 'wat', 'abuot', 'ther', 'have', 'pleas', 'whichh', 'somene']))
SELECT word, word IN ({T.sql_list(S.WHAT_TYPOS)}) OR (len(word) >= 4 AND ({' OR '.join(f"damerau_levenshtein(word, '{x}') <= 1" for x in S.QUESTION_WORDS)})) AS misspelled FROM w"""
)
def question_word_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = messages(spark, sf_dir).select(F.explode(F.regexp_extract_all(T.fold(F.col("text")), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    extra = spark.createDataFrame([(w,) for w in "wher shuold waht wat abuot ther have pleas whichh somene".split()], "word string")
    return words.unionAll(extra).distinct().select("word", S.misspelled_question_word(F.col("word")).alias("misspelled"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("section_id"), S.unit(F.col("embedding")).alias("v"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector, nudged by its right neighbours in place, as a question."""
    v = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return v.select(F.col("vec_id").alias("qid"), S.unit(F.transform("embedding", lambda x, i: x.cast("double") + F.when(i % 3 == 0, 0.05).otherwise(0.0))).alias("qv"))


_UNIT = "(SELECT {id}, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS {v} FROM (SELECT vec_id AS {id}, {e} AS e FROM embeddings {where}))"
VECTORS_SQL = (
    "vs AS " + _UNIT.format(id="section_id", v="v", e="list_transform(embedding, lambda x: x::DOUBLE)", where="")
    + ", qs AS " + _UNIT.format(id="qid", v="qv", e="list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN (i - 1) % 3 = 0 THEN 0.05::DOUBLE ELSE 0 END)", where="WHERE vec_id % 100 = 0")
    + ", sim AS (SELECT qid, section_id, list_sum(list_transform(list_zip(v, qv), lambda z: z[1] * z[2])) AS similarity FROM vs, qs)"
)


@query(f"WITH {VECTORS_SQL} SELECT qid, section_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, section_id DESC) AS rank FROM sim QUALIFY rank <= 10")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by the index of inverted lists, which loses none."""
    near = V.VectorIndex.build(vectors(spark, sf_dir)).nearest(query_vectors(spark, sf_dir), 10)
    return near.select("qid", "section_id", F.round("similarity", 6).alias("similarity"), F.col("n").cast("long").alias("rank"))
