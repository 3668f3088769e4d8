"""Exact ranked search over dual-sorted wavelet trees, one for each shard of documents.

A shard holds a few thousand documents of one map task, numbered by ascending id, so no posting is ever shuffled. Its posting
lists stand one after the other, each ordered by falling impact, and the document numbers in them form one wavelet tree
(levels of bits, each level dealt stably by the bit before). The same lists are so sorted in two ways: at the root by impact,
and down the tree by document. As dealing is stable, the part of a list that falls into a node still falls in impact, and its
first posting bounds all the others.

A question starts at the root with the ranges of its terms. A node's bound is the sum of the terms' weights times their first
impacts; at a leaf, which is one document, it is that document's score. Best-first: the nodes of the highest bounds are
opened, ``BATCH`` at a time, and nodes whose bound is below the k-th best score found are dropped, equal ones never. What a
task found in one shard is the start for its next, so later shards are mostly cut off near the root. Each task gives out at
most k rows for a question; those are merged by a window whose limit works before its shuffle.

A document's score sums ``w * ((SCALE * tf) div (1000 * tf + 8 * m))`` over the question's terms, repeats included, as the
integers of the module's SQL; every statistic (documents, terms, document frequencies) covers the whole table.

Null texts have no terms and are never found; texts of any length are taken whole. Repeated rows are documents of their own.
Documents of equal scores come by ascending id, those without an id last. Equal questions (id and text) are asked once; those
without terms find nothing. Other columns are left aside. An empty table, or one without terms, gives no rows.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from itertools import islice
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, in_arrow, saved, terms

K = 10
SCALE = 1_000_000_000
#: Documents and postings of a shard, at most (a single document may have more postings).
SHARD_DOCS = 4096
SHARD_POSTINGS = 1 << 20
#: Nodes opened at once.
BATCH = 256
#: Questions that go to the tasks at once.
QUESTIONS = 1024
#: Stands for a missing id: behind all others.
NO_ID = (1 << 63) - 1

INDEX = "docs int, ids binary, vocabulary binary, starts binary, impacts binary, bits binary"


def norm(n: int, docs: int, total: int) -> int:
    """The length factor of a document of ``n`` of all ``total`` terms."""
    return 100 - 75 + (75 * n * docs) // total


def _ordered(rows: list[tuple[int, dict[bytes, int]]], docs: int, total: int) -> tuple:
    """Postings by term, then falling impact, then document number."""
    rows.sort(key=lambda r: r[0])
    vocabulary = sorted(set().union(*[r[1] for r in rows]))
    number = {t: i for i, t in enumerate(vocabulary)}
    size = sum(len(r[1]) for r in rows)
    term, tf, doc = np.empty(size, np.int32), np.empty(size, np.int64), np.empty(size, np.int32)
    m, at = np.empty(size, np.int64), 0
    for i, (_, counts) in enumerate(rows):
        end = at + len(counts)
        term[at:end] = [number[t] for t in counts]
        tf[at:end] = list(counts.values())
        doc[at:end], m[at:end] = i, norm(sum(counts.values()), docs, total)
        at = end
    impact = SCALE * tf // (1000 * tf + 8 * m)
    order = np.lexsort((doc, -impact, term))
    starts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1)).astype("<i4")
    return vocabulary, starts, doc[order], impact[order].astype("<i4")


def shard_row(rows: list[tuple[int, dict[bytes, int]]], docs: int, total: int) -> tuple:
    """A shard of ``(id, term counts)`` as a row of the index."""
    vocabulary, starts, doc, impact = _ordered(rows, docs, total)
    levels = []
    for level in reversed(range(height(len(rows)))):
        bit = (doc >> level) & 1
        levels.append(np.packbits(bit.astype(bool)).tobytes())
        doc = np.concatenate([doc[bit == 0], doc[bit == 1]])
    ids = np.array([r[0] for r in rows], "<i8")
    return len(rows), ids.tobytes(), b"\0".join(vocabulary), starts.tobytes(), impact.tobytes(), b"".join(levels)


def height(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


class Vocabulary:
    """The sorted terms of a shard and the ranges of their lists."""

    def __init__(self, vocabulary: bytes, starts: bytes):
        self.words, self.starts = vocabulary.split(b"\0"), np.frombuffer(starts, "<i4")

    def range(self, term: bytes) -> tuple[int, int] | None:
        i = bisect_left(self.words, term)
        return (int(self.starts[i]), int(self.starts[i + 1])) if i < len(self.words) and self.words[i] == term else None


class WaveletTree:
    """A shard opened for search: for each level the number of ones before each place, and the impacts in the level's order."""

    def __init__(self, docs: int, ids: bytes, impacts: bytes, bits: bytes):
        self.ids, self.height = np.frombuffer(ids, "<i8"), height(docs)
        impact = np.frombuffer(impacts, "<i4")
        size = len(impact)
        self.width = size + 1
        self.ones = np.zeros((self.height, self.width), np.int32)
        self.impacts = np.zeros((self.height + 1, self.width), np.int32)
        self.zeros = np.empty(self.height, np.int64)
        for level, packed in enumerate(np.frombuffer(bits, np.uint8).reshape(self.height, -1)):
            bit = np.unpackbits(packed, count=size).astype(bool)
            np.cumsum(bit, out=self.ones[level, 1:])
            self.impacts[level, :size] = impact
            self.zeros[level] = size - self.ones[level, size]
            impact = np.concatenate([impact[~bit], impact[bit]])
        self.impacts[self.height, :size] = impact
        self.ones, self.impacts = self.ones.ravel(), self.impacts.ravel()

    def _bounds(self, level: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
        first = self.impacts[level[:, None] * self.width + low]
        return np.where(high > low, first, 0) @ weights

    def top(self, ranges: list[tuple[int, int]], weights: list[int], k: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best ``(-score, id)`` of this shard and those ``found`` before, in order; scores above 0 only."""
        weights = np.array(weights, np.int64)
        low, high = np.array(ranges, np.int64).T[:, None, :]
        level, doc = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self._bounds(level, low, high, weights)
        while len(bound):
            least = max(1, -found[k - 1][0]) if len(found) >= k else 1
            keep = bound >= least
            level, doc, low, high, bound = level[keep], doc[keep], low[keep], high[keep], bound[keep]
            if len(bound) > BATCH:
                opened = np.argpartition(bound, len(bound) - BATCH)[len(bound) - BATCH :]
            else:
                opened = np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[opened] = False
            leaf = opened[level[opened] == self.height]
            if len(leaf):
                found = nsmallest(k, found + list(zip((-bound[leaf]).tolist(), self.ids[doc[leaf]].tolist())))
            inner = opened[level[opened] < self.height]
            at = level[inner][:, None] * self.width
            ones_low, ones_high, zeros = self.ones[at + low[inner]], self.ones[at + high[inner]], self.zeros[level[inner]][:, None]
            low = np.concatenate([low[rest], low[inner] - ones_low, zeros + ones_low])
            high = np.concatenate([high[rest], high[inner] - ones_high, zeros + ones_high])
            down = np.concatenate([level[inner] + 1] * 2)
            level = np.concatenate([level[rest], down])
            doc = np.concatenate([doc[rest], doc[inner] * 2, doc[inner] * 2 + 1])
            n = int(rest.sum())
            bound = np.concatenate([bound[rest], self._bounds(down, low[n:], high[n:], weights)])
        return found


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n = len(terms(text))
                some, total = some + (n > 0), total + n
        yield pa.RecordBatch.from_pydict({"docs": [some], "total": [total]}, pa.schema([("docs", pa.int64()), ("total", pa.int64())]))

    sums = in_arrow(docs.select("text"), run, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return sums[0] or 0, sums[1] or 0


def build(docs: DataFrame, n: int, total: int, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The shards of ``docs`` (``doc_id, text``), a row each; ``n`` and ``total`` are their ``statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            names = [f.split()[0] for f in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i == 0 else pa.binary()) for i, v in enumerate(shard_row(rows, n, total))], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not (counts := Counter(terms(text))):
                    continue
                if rows and (len(rows) >= shard_docs or size + len(counts) > shard_postings):
                    yield out()
                    rows, size = [], 0
                rows.append((NO_ID if doc_id is None else doc_id, counts))
                size += len(counts)
        if rows:
            yield out()

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, INDEX)


def frequencies(index: DataFrame, asked: list[bytes]) -> dict[bytes, int]:
    """In how many documents each asked term stands, from the lengths of the shards' lists."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for words, starts in zip(b.column(0), b.column(1)):
                lists = Vocabulary(words.as_py(), starts.as_py())
                for i, term in enumerate(sent.value):
                    if r := lists.range(term):
                        df[i] += r[1] - r[0]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    sums = in_arrow(index.select("vocabulary", "starts"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {asked[r["term"]]: r["df"] for r in sums.collect()}  # a row for each asked term at most


def weight(docs: int, df: int) -> int:
    return floor(1000 * log((2 * docs + 2) / (2 * df + 1)))


def ask(index: DataFrame, n: int, questions: list[str | None], k: int = K) -> DataFrame:
    """``question`` (its place in the list), ``doc_id, score``: the best of each task, k for a question at most."""
    counts = [Counter(terms(q)) for q in questions]
    df = frequencies(index, sorted(set().union(*counts)))
    weighted = [{t: c * weight(n, df[t]) for t, c in q.items() if t in df} for q in counts]
    sent = index.sparkSession.sparkContext.broadcast([{t: w for t, w in q.items() if w > 0} for q in weighted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in sent.value]
        for b in batches:
            for r in b.to_pylist():
                lists, tree = Vocabulary(r["vocabulary"], r["starts"]), WaveletTree(r["docs"], r["ids"], r["impacts"], r["bits"])
                for i, question in enumerate(sent.value):
                    here = [(at, w) for t, w in question.items() if (at := lists.range(t))]
                    if here:
                        best[i] = tree.top([at for at, _ in here], [w for _, w in here], k, best[i])
        rows = [(i, None if doc_id == NO_ID else doc_id, -score) for i, found in enumerate(best) for score, doc_id in found]
        names = ["question", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names)

    return in_arrow(index, run, "question long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = QUESTIONS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs`` for each of ``items`` (``item_id, text``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked-search")
    item_type = items.schema["item_id"].dataType.simpleString()
    n, total = statistics(docs)
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    if not n:
        return out
    index = scratch.saved(build(docs, n, total), "index")
    rows = items.select("item_id", "text").distinct().toLocalIterator()
    while asked := list(islice(rows, block)):  # questions pass through the driver, a block at a time
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], f"question long, item_id {item_type}")
        order = Window.partitionBy("question").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = ask(index, n, [r["text"] for r in asked], k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(saved(best.join(F.broadcast(names), "question").drop("question"), "ranked"))
    scratch.drop()
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
stats AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS reps FROM q GROUP BY ALL),
p AS (SELECT doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // total))) AS impact FROM tf, stats),
s AS (SELECT item_id, doc_id, sum(reps * w * impact)::BIGINT AS score FROM qt JOIN w USING (term) JOIN i USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
