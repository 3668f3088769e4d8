"""Queries over web pages, answers, two sources, settings and palettes."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import formats as X, text as T
from quillspark.operators import answers, blend, palette as P, search as S
from quillspark.plans.common import BM25_SQL, QTERMS_SQL, QUESTIONS_SQL, index_sql, query, questions, spread, table, text_index, text_sections
from quillspark.plans.reports import _RGB
from quillspark.sources import html


def _unescape_sql(c: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_TAGS = "regexp_replace({c}, '<[^>]+>', '', 'g')"


@query("SELECT page_id, " + _unescape_sql(_TAGS.format(c="regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")) + " AS heading FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.heading(F.col("html")).alias("heading"))


@query(
    "WITH i AS (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS xs FROM pages) SELECT page_id, unnest(range(len(xs))) AS nth, "
    + _unescape_sql(_TAGS.format(c="unnest(xs)")) + " AS item FROM i"
)
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.items(F.col("html"))).alias("nth", "item")).withColumn("nth", F.col("nth").cast("long"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS xs FROM pages) SELECT page_id, unnest(xs) AS link FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("link"))


@query()
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page; a tag parser has no SQL form, so tests hold it against hand-written pages."""
    pages = table(spark, sf_dir, "pages").withColumn("title", html.heading(F.col("html")))
    return html.sections(pages, "page_id")


@query(
    rf"""WITH {index_sql()}, {QUESTIONS_SQL}, {QTERMS_SQL},
s AS (SELECT qid, p.section_id, round(sum({BM25_SQL}), 4) AS score FROM qt JOIN p USING (term) JOIN t USING (term) JOIN l ON l.section_id = p.section_id, c GROUP BY qid, p.section_id),
r AS (SELECT qid, section_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section_id DESC) - 1 AS rank FROM s QUALIFY rank < 2),
qi AS (SELECT DISTINCT qid, term, coalesce(idf, 1) AS idf FROM qt LEFT JOIN t USING (term)), ne AS (SELECT qid, sum(idf) * 0.5::DOUBLE AS needed FROM qi GROUP BY qid),
li AS (SELECT doc_id AS section_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE doc_id IN (SELECT section_id FROM r)),
se AS (SELECT section_id, line, string_split(regexp_replace(x, '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM li),
un AS (SELECT section_id, line, s, trim(regexp_replace(unit, '\s+', ' ', 'g')) AS unit FROM (SELECT section_id, line, unnest(range(len(ss))) AS s, unnest(ss) AS unit FROM se)),
nu AS (SELECT *, row_number() OVER w - 1 AS n, lead(unit) OVER w AS nxt FROM un WHERE unit <> '' WINDOW w AS (PARTITION BY section_id ORDER BY line, s)),
ca AS (SELECT *, CASE WHEN nxt IS NOT NULL AND len(unit) + len(nxt) < 300 THEN unit || ' ' || nxt ELSE unit END AS answer FROM nu WHERE len(unit) BETWEEN 20 AND 300),
wo AS (SELECT DISTINCT section_id, n, term FROM ({T.sql_terms('ca', 'section_id, n', 'unit')})),
hi AS (SELECT r.qid, wo.section_id, n, sum(idf) AS matched FROM r JOIN wo USING (section_id) JOIN qi ON qi.qid = r.qid AND qi.term = wo.term GROUP BY ALL),
sc AS (SELECT r.qid, rank, ca.n, answer, round(matched + 1.5::DOUBLE - 2 * rank - 0.01::DOUBLE * ca.n, 6) AS score FROM r JOIN ca USING (section_id) JOIN hi ON hi.qid = r.qid AND hi.section_id = ca.section_id AND hi.n = ca.n JOIN ne ON ne.qid = r.qid WHERE matched >= needed)
SELECT qid, answer, score FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, n) = 1"""
)
def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec, q = text_sections(spark, sf_dir), questions(spark, sf_dir)
    ix = text_index(spark, sf_dir)
    return answers.answer_lines(q, S.plain_search(ix, q), sec, ix.terms)


@query()
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts are greedy over each text's words; tested against a plain version on small texts."""
    sec, q = text_sections(spark, sf_dir), questions(spark, sf_dir)
    asked = S.query_terms(q).groupBy("qid").agg(F.collect_set("term").alias("terms"))
    return answers.excerpts(S.plain_search(text_index(spark, sf_dir), q), sec, asked)


_NAMES = "nm AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:2], ' ') AS name FROM documents UNION SELECT DISTINCT string_split(text, ' ')[2] FROM documents)"


@query(
    f"""WITH {QUESTIONS_SQL}, {_NAMES}, nt AS (SELECT DISTINCT name, term FROM ({T.sql_terms('nm', 'name', 'name')})), z AS (SELECT name, count(*) AS n FROM nt GROUP BY name HAVING count(*) > 1 OR len(name) >= 4),
qt AS (SELECT DISTINCT qid, term FROM ({T.sql_terms('q', 'qid', 'query')})), h AS (SELECT qid, name, count(*) AS m FROM qt JOIN nt USING (term) GROUP BY ALL)
SELECT qid, name FROM h JOIN z USING (name) WHERE m = n QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, len(name), name) = 1"""
)
def named_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.split("text", " ")
    docs = table(spark, sf_dir, "documents")
    names = docs.select(F.array_join(F.slice(ws, 1, 2), " ").alias("name")).union(docs.select(F.get(ws, F.lit(1)).alias("name"))).distinct()
    return blend.named_thing(questions(spark, sf_dir), names)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as blocks: colors from their keys, families from their names."""
    k = F.col("p_partkey")
    lab = X.lab(*[(k * m % 256).cast("double") for m in (37, 91, 151)])
    return table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", k.cast("string")).alias("name"), F.concat_ws(" ", "p_type", (k % 40).cast("string")).alias("family"), *[v.alias(n) for n, v in lab.items()],
        (k * 13 % 40).cast("double").alias("contrast"), (k % 11 == 0).alias("see_through"), (k % 7 == 0).alias("less_used"), (k % 5 != 0).alias("pick"),
    )


@query()
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choices that depend on those before, for every part as the base; tested for their rules."""
    c = catalog(spark, sf_dir)
    requests = spread(c.select(F.col("name").alias("base")))
    return P.palettes(requests.withColumn("request", F.col("base")), c, "request", "base")


@query(f"WITH c AS (SELECT p_type, {_RGB}, p_size FROM part) SELECT p_type, round(sum(r * p_size) / sum(p_size), 6) AS r, round(avg(g), 6) AS g, round(stddev_pop(b), 6) AS contrast, round(avg((r > 128)::INT), 6) AS share FROM c GROUP BY p_type")
def mean_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted and plain means, spread and share of each type's colors."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select("p_type", "p_size", *[(k * m % 256).cast("double").alias(n) for n, m in (("r", 37), ("g", 91), ("b", 151))])
    return c.groupBy("p_type").agg(
        F.round(F.sum(F.col("r") * F.col("p_size")) / F.sum("p_size"), 6).alias("r"), F.round(F.avg("g"), 6).alias("g"), F.round(F.stddev_pop("b"), 6).alias("contrast"),
        F.round(F.avg((F.col("r") > 128).cast("int")), 6).alias("share"),
    )


@query("SELECT p_type, p_size, arg_min(p_name, (len(p_name), p_name)) AS name, count(*) AS same FROM part GROUP BY ALL")
def same_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parts that look alike the one with the shortest name."""
    return table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.min_by("p_name", F.struct(F.length("p_name"), F.col("p_name"))).alias("name"), F.count("*").alias("same"))


@query("SELECT a.p_partkey AS building, b.p_partkey AS place FROM part a JOIN part b ON a.p_partkey < 60 AND b.p_partkey BETWEEN 60 AND 119 AND list_has_any(string_split(a.p_name, ' '), string_split(b.p_name, ' '))")
def build_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings and places that share a kind: an equi-join on kinds, each pair once."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("kind"))
    a = p.where("p_partkey < 60").select(F.col("p_partkey").alias("building"), "kind")
    b = p.where("p_partkey between 60 and 119").select(F.col("p_partkey").alias("place"), "kind")
    return a.join(b, "kind").select("building", "place").distinct()
