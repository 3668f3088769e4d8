"""Sharding by extendible hashing: a directory indexed by the leading bits of a hash, and only what is too large splits.

Each document's key hashes to ``BITS`` bits. Starting from one bucket, a bucket above the byte limit splits on its next
bit, until every bucket fits. The sums of ``STEP`` further bits at a time are taken in one pass over the buckets that are
still too large, so the number of passes doesn't depend on the number of shards.

A bucket whose rows all share one hash cannot split by bits: equal keys. It stops at once and is cut by running sums of
bytes in the order of its texts' hashes instead; like rows are counted where they lie, so that a key that holds a large part
of all rows meets in no single task, and the cuts don't depend on how rows are dealt. A single row above the limit gets a
shard of its own; nothing else can exceed the limit.

Nulls: a null key hashes as the empty string, a null text has no bytes. Repeated rows share their hash and are cut as
said. An empty table gives no rows. Columns named ``shard``, ``depth`` or ``n_bytes`` are replaced.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import saved

BITS = 60
STEP = 12
LIMIT_BYTES = 1 << 20


def key_hash(key: Column) -> Column:
    """60 bits of MD5, as a long."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(bits, cells)]: for each cell (prefix of so many bits) that is settled in that pass, the depth of its bucket and whether it must be cut."""
    found, depth, todo = [], 0, rows.select("_hash", "n_bytes")
    while depth < BITS:
        deeper = min(BITS, depth + STEP)
        cells = saved(
            todo.groupBy(prefix(F.col("_hash"), deeper).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"), F.min("_hash").alias("low"), F.max("_hash").alias("high")), "cells"
        )
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deeper)))).withColumn("at", F.expr(f"shiftright(cell, {deeper} - depth)"))
        sums = levels.groupBy("depth", "at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "at", ((F.col("bytes") > limit) & (F.col("n") > 1)).alias("cut"))
        settled = levels.select("cell", "depth", "at").join(fits, ["depth", "at"]).groupBy("cell").agg(F.min(F.struct("depth", "cut")).alias("s"))
        settled = saved(settled.select("cell", "s.depth", "s.cut"), "directory")
        found.append((deeper, settled))
        still = cells.select("cell").join(settled, "cell", "left_anti")
        if still.isEmpty():
            break
        todo = todo.withColumn("cell", prefix(F.col("_hash"), deeper)).join(still, "cell", "left_semi").drop("cell")
        depth = deeper
    return found


def assign(df: DataFrame, limit: int = LIMIT_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``n_bytes``, ``shard`` (the bits of its bucket; after a dot, the part of one that was cut) and ``depth``."""
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    old = [F.col(c) for c in df.columns if c not in ("n_bytes", "shard", "depth") or c in (text, key)]
    rows = df.select(F.struct(*old).alias("row"), bytes_.alias("n_bytes"), key_hash(F.col(key)).alias("_hash"))
    narrow = saved(rows.select("_hash", "n_bytes"), "sizes")
    out, depth, cut = rows, F.lit(None).cast("int"), F.lit(None).cast("boolean")
    found = directory(narrow, limit)
    for bits, cells in found:
        own = cells.select(F.col("cell").alias("_cell"), F.col("depth").alias(f"_depth{bits}"), F.col("cut").alias(f"_cut{bits}"))
        out = out.withColumn("_cell", prefix(F.col("_hash"), bits)).join(own, "_cell", "left").drop("_cell")
        depth, cut = F.coalesce(depth, F.col(f"_depth{bits}")), F.coalesce(cut, F.col(f"_cut{bits}"))
    out = out.withColumns({"depth": depth, "_cut": cut})
    out = out.drop(*[c for c in out.columns if c.startswith(("_depth", "_cut")) and c != "_cut"])
    shard = F.substring(F.lpad(F.bin("_hash"), BITS, "0"), F.lit(1), F.col("depth"))
    whole = out.where(F.coalesce(~F.col("_cut"), F.lit(True))).withColumn("shard", shard)
    new = [c for c in ("n_bytes", "shard", "depth") if c not in (text, key)]
    if all(cells.where("cut").isEmpty() for _, cells in found):
        return whole.select("row.*", *new)
    parts = out.where("_cut").withColumn("_text", F.xxhash64(F.col("row").getField(text))).withColumn("_part", F.spark_partition_id())
    parts = numbered(saved(parts, "equal-keys"), ["_hash", "_text", "n_bytes"])
    half = limit / 2  # rows of at most half the limit that start in one half-limit stretch fit together; larger ones stand alone
    piece = F.when(F.col("n_bytes") > half, F.concat(F.lit("r"), F.col("_nth"))).otherwise(F.floor(F.col("_before") / half).cast("string"))
    parts = parts.withColumn("shard", F.concat_ws(".", shard, piece))
    return whole.select("row", *new).unionAll(parts.select("row", *new)).select("row.*", *new)


def numbered(rows: DataFrame, same: list[str]) -> DataFrame:
    """Adds ``_nth`` and ``_before``: rows and bytes before each row among those of its ``_hash``, in the order of ``same``.

    Rows alike in ``same`` are counted first, by ``_part`` (where they lie), so however many there are, no task has them
    all, and the numbers that they get as a group don't depend on how they are dealt.
    """
    here = rows.groupBy(*same, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    here = here.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    group = here.groupBy(*same).agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy("_hash").orderBy(*same).rowsBetween(Window.unboundedPreceding, -1)
    group = group.select(*same, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum(F.col("_n") * F.col("n_bytes")).over(earlier), F.lit(0)).alias("_bytes"))
    own = Window.partitionBy(*same, "_part").orderBy(F.lit(1))
    out = rows.withColumn("_i", F.row_number().over(own) - 1).join(here.drop("_n"), [*same, "_part"]).join(group, same)
    return out.withColumns({"_nth": F.col("_rows") + F.col("_at") + F.col("_i"), "_before": F.col("_bytes") + (F.col("_at") + F.col("_i")) * F.col("n_bytes")})


def write(assigned: DataFrame, out: str) -> None:
    """One folder for each shard, named by a letter and its bits, as folders named by digits would be read as numbers."""
    named = assigned.withColumn("shard", F.concat(F.lit("b"), "shard"))
    named.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write`` with their shards' names."""
    return spark.read.parquet(path).withColumn("shard", F.substr("shard", F.lit(2)))


SQL = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT *, depth, h >> (60 - depth) AS slot FROM d CROSS JOIN range(0, 41) r(depth)),
s AS (SELECT depth, slot, sum(n_bytes) AS bytes, min(h) AS low, max(h) AS high FROM p GROUP BY depth, slot),
f AS (SELECT p.doc_id, p.n_bytes, p.h, min(p.depth) AS depth FROM p JOIN s USING (depth, slot) WHERE s.bytes <= 1048576 OR s.low = s.high GROUP BY ALL)
SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, depth::INT) AS shard, depth::INT AS depth FROM f
"""
