"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a hash of their ids. A document's virtual finish time is the number of
its source's words up to and with it, divided by the source's target; a second copy of the source follows the first.
The copies of all sources, in order of finish time, are taken until the total budget is reached: at finish time 1
every source has just its target.

Running sums have two levels (hash ranges of a source, then within a range), and so has the search for the cut (ranges
of finish time, refined twice), so no task sees a whole source or the whole order. Only sums leave the executors.

Nulls: a text that is null has no words; a null source is a source of its own, the last; a null id hashes as the empty
string. Documents without words are never taken. Repeated rows are separate documents. An empty table gives no rows.
All columns of the input are kept; one with the name of a new column is replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, drop_path, new_path

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Ranges of finish time at each of the levels of the search for the cut.
RANGES = 4096
NEW = ("size", "source_size", "target", "copies", "taken")
LEVELS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to one row (key, source_size) for each source: its share, or twice its size and the rest reshared.

    Sources in order of the level at which they are full; the first that isn't full at the level that the ones
    before it leave gives the level of all others.
    """
    n = len(WEIGHTS)
    place = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % n + 1).cast("int"))
    full = F.lit(float(MOST)) * F.col("source_size") / F.col("weight")
    order = Window.orderBy("full", "key")
    w = sizes.withColumn("weight", weight).withColumn("full", full).withColumn("budget", F.lit(SHARE) * F.sum("source_size").over(Window.partitionBy()))
    taken = F.coalesce(F.sum(F.lit(MOST) * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", (F.col("budget") - taken) / rest)
    open_level = F.min(F.when(F.col("full") >= F.col("level"), F.struct("full", "key", "level"))).over(Window.partitionBy())
    w = w.withColumn("first", open_level)
    capped = F.col("first").isNull() | (F.struct("full", "key") < F.struct(F.col("first.full"), F.col("first.key")))
    return w.select("key", "source_size", "budget", F.when(capped, F.lit(float(MOST)) * F.col("source_size")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def placed(df: DataFrame, source: str, doc_id: str) -> DataFrame:
    """Adds ``key, source_size, target, budget, _end`` (words of the source up to and with this row) to rows with ``size``."""
    h = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    rows = df.withColumns({"key": F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1")), "_h": h, "_range": F.substring(h, 1, 3)})
    ranges = rows.groupBy("key", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    goal = targets(ranges.groupBy("key").agg(F.sum("_sum").alias("source_size")))
    within = Window.partitionBy("key", "_range").orderBy("_h", doc_id, "size").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_run", F.sum("size").over(within))
    out = run.join(base.join(goal, "key").select("key", "_range", "_base", "source_size", "target", "budget"), ["key", "_range"])
    return out.withColumn("_end", F.col("_base") + F.col("_run")).drop("_h", "_range", "_run", "_base")


def finish(copy: int) -> Column:
    return F.when(F.col("target") > 0, (F.col("_end") + copy * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))


def cut(rows: DataFrame) -> tuple[float, str] | None:
    """Finish time and source of the last copy that fits the budget; None if no copy does."""
    copies = rows.where("size > 0").select("size", "key", "budget", F.explode(F.array(*[finish(i) for i in range(MOST)])).alias("t"))
    base, scale = 0, 1.0
    for level in range(LEVELS):
        scale *= RANGES
        at = F.least(F.floor(F.col("t") * scale), F.lit(2**62))
        sums = copies.groupBy(at.alias("at")).agg(F.sum("size").alias("n"), F.max("budget").alias("budget"), F.max(F.struct("t", "key")).alias("last"))
        run = sums.withColumn("n", F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        over = run.where(F.col("n") + base > F.col("budget")).orderBy("at").first()
        under = run.where(F.col("n") + base <= F.col("budget")).orderBy(F.desc("at")).first()
        if under:
            last = under["last"]
        elif level == 0:
            last = None
        if over is None:
            return tuple(last) if last else None
        base += under["n"] if under else 0
        copies = copies.where(at == over["at"])
    order = Window.orderBy("t", "key").rowsBetween(Window.unboundedPreceding, 0)
    fits = copies.withColumn("n", F.sum("size").over(order)).where(F.col("n") + base <= F.col("budget")).orderBy(F.desc("t"), F.desc("key")).first()
    return (fits["t"], fits["key"]) if fits else (tuple(last) if last else None)


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Adds ``size, source_size, target, copies`` (0 to 2) and ``taken`` (size times copies) to every row."""
    spark = df.sparkSession
    old = [F.col(c) for c in df.columns if c not in NEW or c in (text, source, doc_id)]
    rows = df.select(F.struct(*old).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    path = new_path(spark, "mixing")
    placed(rows.drop("row"), "source", "doc_id").select("key", "size", "source_size", "target", "budget", "_end").write.parquet(path)
    last = cut(spark.read.parquet(path))
    drop_path(spark, path)
    return _decided(placed(rows, "source", "doc_id"), last).select("row.*", *[c for c in NEW if c not in (text, source, doc_id)])


def _decided(rows: DataFrame, last: tuple[float, str] | None) -> DataFrame:
    copies = F.lit(0)
    if last:
        for i in range(MOST):
            t = finish(i)
            copies = copies + F.when((F.col("size") > 0) & ((t < last[0]) | ((t == last[0]) & (F.col("key") <= last[1]))), 1).otherwise(0)
    return rows.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("key", "budget", "_end")


def plan(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """As ``mix``, but returns the decisions alone (``doc_id, size, source_size, target, copies, taken``); reads texts once."""
    spark = df.sparkSession
    path, path2 = new_path(spark, "sizes"), new_path(spark, "mixing")
    df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")).write.parquet(path)
    placed(spark.read.parquet(path), "source", "doc_id").drop("source").write.parquet(path2)
    drop_path(spark, path)
    rows = spark.read.parquet(path2)
    return _decided(rows, cut(rows)).select("doc_id", "size", "source_size", "target", "copies", "taken")


def expand(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each row of ``df``, with its own columns only, as often as it is taken."""
    whole = mix(df.select(F.struct("*").alias("_row"), F.col(text).alias("_t"), F.col(source).alias("_s"), F.col(doc_id).alias("_d")), "_t", "_s", "_d")
    return whole.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS s FROM d GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 1.5::DOUBLE * (sum(s) OVER ())::BIGINT AS b FROM s),
f AS (SELECT *, 2::DOUBLE * s / w AS r FROM w),
l AS (SELECT *, (b - coalesce(sum(2 * s) OVER (ORDER BY r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                / (sum(w) OVER (ORDER BY r, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM f),
o AS (SELECT r AS r0, k AS k0, level AS level0 FROM l WHERE r >= level ORDER BY r, k LIMIT 1),
t AS (SELECT l.k, s, b, CASE WHEN o.r0 IS NULL OR (r, l.k) < (o.r0, o.k0) THEN 2::DOUBLE * s ELSE o.level0 * w END AS target FROM l LEFT JOIN o ON true),
e AS (SELECT d.*, t.s, t.b, t.target, (sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS c FROM d JOIN t USING (k)),
p AS (SELECT e.*, i, CASE WHEN target > 0 THEN (c + i * s)::DOUBLE / target ELSE 0 END AS f FROM e CROSS JOIN (VALUES (0), (1)) v(i)),
g AS (SELECT doc_id, size, s, target, h, k, c, CASE WHEN size > 0 AND sum(size) OVER (ORDER BY f, k, h, doc_id ROWS UNBOUNDED PRECEDING) <= b THEN size ELSE 0 END AS take FROM p)
SELECT doc_id, size, s AS source_size, target, sum(take)::BIGINT AS taken FROM g GROUP BY doc_id, size, s, target, h, k, c
"""
