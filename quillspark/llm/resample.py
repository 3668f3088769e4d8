"""Target-distribution importance resampling over hashed word runs.

One scan of each document keeps a ring of running CRC-32 states, one for each of the last ``ORDER`` starts. A word extends
each of them by a space and itself and opens a new one, so every run of 1 to ``ORDER`` words costs one step over its last word,
and no run is ever put together as a string. A state modulo ``BUCKETS`` is the run's bucket; the scan emits them packed, two
bytes each, and all that follows reads them instead of the texts.

A bucket's gain tells how much likelier it is in the target than in the documents (1000 times the log of the smoothed
ratio). A document's weight sums its runs' gains. To that the Gumbel noise of its id is added, fixed by a seed, and of the
documents with at least ``LEAST`` words the highest scores are drawn: a sample without replacement, by weight. Ranks come
from a range sort with the offsets of its parts, in no single task. What goes to the driver and back is one gain for each of
the ``BUCKETS`` buckets.

Null texts count as empty: no runs, weight 0, never drawn. Texts of any length are taken whole. Rows of one id have the same
noise; equal scores go by id, rows without an id last (their noise is that of the empty id), then by runs and weight.
Repeated rows are documents of their own. Other columns stay; those named like the new ones are replaced. An empty target
or table is allowed: all its counts are 0.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import Scratch, in_arrow, ranked, terms

ORDER = 3
BUCKETS = 10_000
#: Words of a document that can be drawn, the share drawn in percent, and the seed of the noise.
LEAST = 20
PERCENT = 5
SEED = 42

_NEW = ["n_features", "weight", "score", "rank"]


def ring(words: list[bytes], order: int = ORDER) -> list[int]:
    """The CRC-32 of each run of 1 to ``order`` words joined by a space, by where runs end, the newest start first."""
    crc, out, states = zlib.crc32, [], []
    for word in words:
        more = b" " + word
        states = [crc(word), *[crc(more, s) for s in states[: order - 1]]]
        out += states
    return out


def buckets(text: str | None, order: int = ORDER, n: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run."""
    words = terms(text)
    return len(words), (np.array(ring(words, order), np.uint32) % np.uint32(n)).astype("<u2")


def scanned(df: DataFrame, order: int = ORDER, n: int = BUCKETS) -> DataFrame:
    """``_words`` and ``_buckets`` (packed) in place of ``text``."""
    if not 0 < n <= 1 << 16:
        raise ValueError("buckets are packed in two bytes: between 1 and 65536 of them")
    kept = [c for c in df.columns if c != "text"]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("_words", T.LongType()), T.StructField("_buckets", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [buckets(t, order, n) for t in b.column(b.schema.names.index("text")).to_pylist()]
            new = [pa.array([k for k, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(c)) for c in kept] + new, [*kept, "_words", "_buckets"])

    return in_arrow(df, run, schema)


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch of rows, and where each row's begin and end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    return np.frombuffer(column.buffers()[2] or b"", "<u2")[: ends[-1]], ends


def counts(scanned: DataFrame, n: int = BUCKETS) -> DataFrame:
    """``bucket, n``: a task gives at most ``n`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            values, ends = _packed(b.column(0))
            total += np.bincount(values[ends[0] :], minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return in_arrow(scanned.select("_buckets"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """Of each bucket, from the counts in the documents and in the target (``bucket, n``)."""
    s, t = np.zeros(n), np.zeros(n)
    for into, of in ((s, source), (t, target)):
        for bucket, k in of.collect():  # n rows at most
            into[bucket] = k
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """``n_features`` and ``weight`` in place of the buckets."""
    kept = [c for c in scanned.columns if c != "_buckets"]
    schema = T.StructType([scanned.schema[c] for c in kept] + [T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    sent = scanned.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = _packed(b.column(b.schema.names.index("_buckets")))
            sums = np.zeros(len(values) + 1, np.int64)
            np.cumsum(sent.value[values], out=sums[1:])
            new = [pa.array((ends[1:] - ends[:-1]).astype(np.int64)), pa.array(sums[ends[1:]] - sums[ends[:-1]])]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(c)) for c in kept] + new, [*kept, "n_features", "weight"])

    return in_arrow(scanned, run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, order: int = ORDER, n: int = BUCKETS) -> DataFrame:
    """``docs`` without its text, with ``n_features``, ``weight``, ``score`` and ``rank`` (null if it isn't drawn)."""
    scratch = Scratch(docs.sparkSession, "resample")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _NEW])
    rows = scratch.saved(scanned(docs, order, n), "buckets")
    gain = gains(counts(rows, n), counts(scanned(target.select("text"), order, n), n), n)
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")
    scored = scratch.saved(weighed(rows, gain).withColumn("score", F.col("weight") + noise), "scored")
    scratch.drop("buckets")
    drawn = scored.where(F.col("_words") >= least).count() * percent // 100
    sort = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    high = ranked(scored.where(F.col("_words") >= least), sort, scratch, "sorted")
    high = high.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    low = scored.where(F.col("_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(low).drop("_words")
