"""Inputs of the queries: the test tables in the roles of sections, questions and messages."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import counted
from quillspark.operators.index import Index
from quillspark.operators.search import features
from quillspark.operators.store import shared_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A few small files give fewer partitions than there are cores; only then rows are dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections that have a text only."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), "text"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of pages: the source is the project, with a folder for each language; some are the project's home, a folder's overview or changes.

    The first two words are the title, the third the heading.
    """
    ws, d = F.split(F.trim("text"), r"\s+", 4), F.col("doc_id")  # no more than three words are used
    page = F.when(d % 97 == 0, F.concat("lang", F.lit("/overview"))).when(d % 101 == 1, "home").when(d % 103 == 2, F.concat("lang", F.lit("/changelog_"), d.cast("string")))
    return spread(table(spark, sf_dir, "documents")).select(
        d.alias("section_id"), F.concat_ws("/", "source", page.otherwise(F.concat_ws("/", "lang", d.cast("string")))).alias("path"),
        F.array_join(F.slice(ws, 1, 2), " ").alias("page_title"), F.coalesce(F.get(ws, F.lit(2)), F.lit("")).alias("heading"), "text", F.col("lang").alias("meta"),
    )


SECTIONS_SQL = r"""sec AS (SELECT doc_id AS section_id, source || '/' || CASE WHEN doc_id % 97 = 0 THEN lang || '/overview' WHEN doc_id % 101 = 1 THEN 'home' WHEN doc_id % 103 = 2 THEN lang || '/changelog_' || doc_id ELSE lang || '/' || doc_id END AS path,
  array_to_string(ws[1:2], ' ') AS page_title, coalesce(ws[3], '') AS heading, text, lang AS meta FROM (SELECT *, regexp_split_to_array(trim(text), '\s+') AS ws FROM documents))"""


def text_index(spark: SparkSession, sf_dir: str, level: str = "postings") -> Index:
    """The stored index of the documents' texts, which the first search builds: these are searched by words alone, so without pairs."""
    return shared_index(text_sections(spark, sf_dir), "texts", level)


def section_index(spark: SparkSession, sf_dir: str, level: str = "all") -> Index:
    """The same of the documents as sections of pages."""
    return shared_index(sections(spark, sf_dir), "sections", level)


def counted_index(spark: SparkSession, sf_dir: str) -> Index:
    """An index of the same for one whole search: its vocabulary, and the postings of what is asked."""
    return counted.index(sections(spark, sf_dir), features)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


QUESTIONS_SQL = "q AS (SELECT item_id AS qid, text AS query FROM benchmark)"


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items, and of every hundredth document two more: its title, heading and project (every second title mistyped), and one for a list."""
    s = sections(spark, sf_dir).where("section_id % 100 = 0")
    title, n, project = F.col("page_title"), F.length("page_title"), F.split_part("path", F.lit("/"), F.lit(1))
    mistyped = F.concat(F.substring(title, F.lit(1), n - 2), F.substring(title, n, F.lit(1)), F.substring(title, n - 1, F.lit(1)))
    about = s.select((-1 - 2 * F.col("section_id")).alias("qid"), F.concat_ws(" ", F.when(F.col("section_id") % 200 == 0, mistyped).otherwise(title), "heading", project).alias("query"))
    lists = s.select((-2 - 2 * F.col("section_id")).alias("qid"), F.concat(F.lit("which "), F.split_part(title, F.lit(" "), F.lit(1)), F.lit(" are there in "), project, F.lit(" "), "meta").alias("query"))
    return about.unionAll(lists).unionAll(questions(spark, sf_dir))


ALL_QUESTIONS_SQL = r"""q AS (SELECT item_id AS qid, text AS query FROM benchmark
  UNION ALL SELECT -1 - 2 * section_id, CASE WHEN section_id % 200 = 0 THEN left(page_title, len(page_title) - 2) || right(page_title, 1) || substr(page_title, len(page_title) - 1, 1) ELSE page_title END || ' ' || heading || ' ' || split_part(path, '/', 1) FROM sec WHERE section_id % 100 = 0
  UNION ALL SELECT -2 - 2 * section_id, 'which ' || split_part(page_title, ' ', 1) || ' are there in ' || split_part(path, '/', 1) || ' ' || meta FROM sec WHERE section_id % 100 = 0)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


MESSAGES_SQL = "m AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def fields_sql(with_sections: bool = False) -> str:
    """CTEs sec, f (fields) and tok (their words)."""
    if not with_sections:
        f = "f AS (SELECT doc_id AS section_id, 'text' AS field, text AS v, 1 AS w FROM documents), sec AS (SELECT doc_id AS section_id FROM documents)"
    else:
        f = SECTIONS_SQL + """,
f AS (SELECT section_id, 'text' AS field, text AS v, 1 AS w FROM sec UNION ALL SELECT section_id, 'title', page_title || ' ' || heading, 3 FROM sec
  UNION ALL SELECT section_id, 'path', translate(path, '/_', '  '), 2 FROM sec UNION ALL SELECT section_id, 'meta', meta, 1 FROM sec)"""
    return f"""{f},
tok AS ({T.sql_terms('f', 'section_id, field, w', 'v')})"""


def index_sql(with_sections: bool = False) -> str:
    """CTEs tok, p (postings), l (lengths), c (corpus), t (term statistics); with sections also bg and bt (bigrams)."""
    out = f"""{fields_sql(with_sections)},
p AS (SELECT section_id, term, sum(w)::BIGINT AS tf FROM tok GROUP BY ALL),
l AS (SELECT sec.section_id, coalesce(sum(tf), 0)::BIGINT AS length FROM sec LEFT JOIN p USING (section_id) GROUP BY ALL),
c AS (SELECT count(*) AS n, avg(length) AS avg_len FROM l),
t AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM c) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p GROUP BY term)"""
    bigrams = """,
bg AS (SELECT section_id, term || ' ' || nxt AS pair, sum(w)::BIGINT AS tf FROM (SELECT *, lead(term) OVER (PARTITION BY section_id, field ORDER BY pos) AS nxt
  FROM tok WHERE field IN ('text', 'title')) WHERE nxt IS NOT NULL GROUP BY ALL),
bt AS (SELECT pair, count(*) AS df, ln(1 + ((SELECT n FROM c) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM bg GROUP BY pair)"""
    return out + bigrams


QTERMS = T.sql_terms("q", "qid", "query")
QTERMS_SQL = f"qt AS (SELECT qid, term, min(pos) AS pos, arg_min(word, pos) AS word FROM ({QTERMS}) GROUP BY qid, term)"
BM25_SQL = "t.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.length / c.avg_len))"
