"""Exact removal of long repeated strings, by blockwise suffix sorting with a difference cover.

Every byte is removed that lies in a string of ``LENGTH`` bytes which also starts anywhere else, in any document.

1. Anchors. Equal strings of that length have the same anchor (their smallest gram of bytes), so suffixes fall into buckets
   by anchor; the windows with one anchor form a span of text. An anchor that occurs once in the corpus settles its span:
   nothing in it repeats. If all its spans are equal, all of them repeat.
2. What remains are buckets of different spans around one anchor: the ends of repeated passages. Of each different span one
   is fetched, and the suffixes of whole buckets are sorted a block of bounded size at a time, long ties resolved by the
   ranks of a difference cover (see ``cover``). Neighbours are compared byte by byte, so no hash decides there.
3. A bucket above ``BUCKET_BYTES`` is split by more of its suffixes' own bytes, and its parts are sorted in the same way.
   Its windows start between 0 and ``REACH`` bytes before the anchor; those that start a to b bytes before it all hold the
   a bytes before the anchor and the ``REACH - b`` behind it, so equal windows agree there. Halving [a, b] lengthens what
   they must share and so splits the bucket, until at a = b the windows of a bucket are equal and are one piece.
4. Each document's repeated windows are merged and cut out.

Whether whole spans (1) and pieces (3) are equal is decided by two 64-bit hashes, of the gram and of the span. Null texts
count as empty; texts shorter than the length stay as they are. Documents are told apart by id and a hash of their text, so
repeated rows count as repeats of each other, as do documents without an id. Very long texts are taken whole, in overlapping
stretches. Other columns pass through ``remove``. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import cover, rolling
from quillspark.llm.common import Scratch, in_arrow, saved

LENGTH = rolling.LENGTH
#: Bytes before the anchor at which a window can start, at most.
REACH = LENGTH - rolling.GRAM
#: Text that is sorted at once, and that a bucket holds unless it is split.
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 1 << 20
#: Bytes of strings that leave a task at once.
OUT_BYTES = 4 << 20


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc`` and ``tid`` tell rows apart: id (the least long if null) and 64-bit hash of the text."""
    return docs.withColumns({"doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), "tid": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def anchors(docs: DataFrame, text: str) -> DataFrame:
    """``doc, tid, gram, span, place`` of every anchor; ``place`` packs first window, windows and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, tids, found = [], [], []
            for doc, tid, t in zip(b.column("doc").to_pylist(), b.column("tid").to_pylist(), b.column("t")):
                data = _bytes(t.as_py())
                if len(data) >= LENGTH:
                    a = rolling.anchors(data)
                    found.append((a["gram"].view(np.int64), a["span"].view(np.int64), (a["low"] << 24) | ((a["high"] - a["low"]) << 12) | (a["at"] - a["low"])))
                    docs_.append(np.full(len(a["gram"]), doc))
                    tids.append(np.full(len(a["gram"]), tid))
            if found:
                gram, span, place = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_pydict({"doc": pa.array(np.concatenate(docs_)), "tid": pa.array(np.concatenate(tids)), "gram": pa.array(gram), "span": pa.array(span), "place": pa.array(place)})

    return in_arrow(docs.select("doc", "tid", F.col(text).alias("t")), run, "doc long, tid long, gram long, span long, place long")


def low(place: Column) -> Column:
    return F.shiftright(place, 24)


def windows(place: Column) -> Column:
    """Number of windows less one."""
    return F.shiftright(place, 12).bitwiseAND(F.lit(4095))


#: A row for each span or part of one: its bucket and piece, where the piece begins in the span (in windows), the piece's
#: windows less one, its anchor, its range of starts before the anchor, how often the span occurs, and its bytes.
PIECES = "key long, piece long, gram long, span long, begin int, last int, at int, a int, b int, n long, string binary"
_KINDS = dict(zip((f.split()[0] for f in PIECES.split(", ")), (pa.int64(),) * 4 + (pa.int32(),) * 5 + (pa.int64(), pa.binary())))


class _Rows:
    """Rows of ``PIECES`` that leave as a batch when their bytes fill one."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += len(row[-1]) + 100
        if self.bytes >= OUT_BYTES:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_KINDS)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(_KINDS.items(), columns)})


def whole_spans(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``PIECES`` of the wanted spans (doc, tid, gram, span, n, place), each a piece of its gram's bucket."""
    lists = wanted.groupBy("doc", "tid").agg(F.collect_list(F.struct("gram", "span", "n", "place")).alias("spans"))
    once = squeezed(docs.join(lists.select("doc", "tid"), ["doc", "tid"], "left_semi"), text).groupBy("doc", "tid").agg(F.first("z").alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, out = zstandard.ZstdDecompressor(), _Rows()
        for b in batches:
            for z, spans in zip(b.column("z"), b.column("spans")):
                data = unpack.decompress(z.as_py())
                columns = [spans.values.field(k).to_pylist() for k in ("gram", "span", "n", "place")]
                for gram, span, n, place in zip(*columns):
                    low_, last = place >> 24, (place >> 12) & 4095
                    yield from out.add((gram, span, gram, span, 0, last, place & 4095, 0, REACH, n, data[low_ : low_ + last + LENGTH]))
        yield out.batch()

    return in_arrow(once.join(lists, ["doc", "tid"]).select("z", "spans"), run, PIECES)


def halves(pieces: DataFrame) -> DataFrame:
    """The pieces of split buckets: each piece's windows by the two halves of its range, in buckets of what all of a half share."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for rows in batches:
            for _, _, gram, span, begin, last, at, a, b, n, string in zip(*[rows.column(k).to_pylist() for k in _KINDS]):
                middle = (a + b) // 2
                for x, y in ((a, middle), (middle + 1, b)):
                    first, end = max(0, at - y), min(last, at - x)
                    if first <= end:
                        part = string[first : end + LENGTH]
                        shared = string[at - x : at + LENGTH - y]
                        key = xxhash.xxh3_64_intdigest(shared, (gram + 257 * x + y) & (2**64 - 1))
                        piece = xxhash.xxh3_64_intdigest(part, at - first)
                        yield from out.add((key - 2**63, piece - 2**63, gram, span, begin + first, end - first, at - first, x, y, n, part))
        yield out.batch()

    return in_arrow(pieces, run, PIECES)


def squeezed(docs: DataFrame, text: str) -> DataFrame:
    """``doc, tid, z``: the text's bytes, compressed before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [pack.compress(_bytes(t.as_py()).tobytes()) for t in b.column("t")]
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc"), "tid": b.column("tid"), "z": pa.array(z, pa.binary())})

    return in_arrow(docs.select("doc", "tid", F.col(text).alias("t")), run, "doc long, tid long, z binary")


RUNS = "key long, piece long, first int, end int"


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def sort_blocks(pieces: DataFrame) -> DataFrame:
    """``key, piece, first, end``: stretches of repeated windows of each piece, counted from its first window.

    Buckets arrive whole and one after another; a block is sorted when the next bucket would overfill it.
    """

    def block(rows: list[tuple]) -> pa.RecordBatch:
        text = b"".join(r[4] for r in rows)
        at = np.cumsum([0] + [len(r[4]) for r in rows[:-1]])
        count = np.array([r[3] + 1 for r in rows])
        begin = np.cumsum(count) - count
        starts = np.repeat(at - begin, count) + np.arange(count.sum())
        flags = cover.repeated(text, starts, np.repeat(np.array([min(r[2], 2) for r in rows]), count), LENGTH)
        out = [(r[0], r[1], a, z) for r, s, c in zip(rows, begin, count) for a, z in _runs(flags[s : s + c])]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_pydict({"key": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int64()), "first": pa.array(cols[2], pa.int32()), "end": pa.array(cols[3], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bucket, size, held = [], [], 0, 0
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("key", "piece", "n", "last", "string")]):
                if bucket and bucket[0][0] != r[0]:
                    if rows and size + held > BLOCK_BYTES:
                        yield block(rows)
                        rows, size = [], 0
                    rows, size = rows + bucket if rows else bucket, size + held
                    bucket, held = [], 0
                bucket.append(r)
                held += len(r[4])
        for last in ([rows, bucket] if size + held > BLOCK_BYTES else [rows + bucket]):
            if last:
                yield block(last)

    return in_arrow(pieces.select("key", "piece", "n", "last", "string").repartition("key").sortWithinPartitions("key"), run, RUNS)


def repeated_windows(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """``gram, span, first, end``: stretches of repeated windows of each span, from ``PIECES`` of whole spans."""
    found = []
    while True:  # ranges of starts halve each time, so this ends after log2(REACH) rounds; one, if no bucket is large
        each = pieces if not found else pieces.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.first("last").alias("last"), F.first("string").alias("string"))
        sizes = each.groupBy("key").agg(F.sum(F.length("string")).alias("bytes"), F.count("*").alias("pieces"))
        large = scratch.saved(sizes.where((F.col("bytes") > BUCKET_BYTES) & (F.col("pieces") > 1)).select("key"), "large")
        runs = scratch.saved(sort_blocks(each.join(large, "key", "left_anti")), "runs")
        if found:
            runs = pieces.select("key", "piece", "gram", "span", "begin").join(runs, ["key", "piece"])
            found.append(runs.select("gram", "span", (F.col("begin") + F.col("first")).alias("first"), (F.col("begin") + F.col("end")).alias("end")))
        else:
            found.append(runs.select(F.col("key").alias("gram"), F.col("piece").alias("span"), "first", "end"))
        if large.isEmpty():
            break
        pieces = scratch.saved(halves(pieces.join(large, "key", "left_semi").select(*_KINDS)), "pieces")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def repeats(docs: DataFrame, text: str) -> DataFrame:
    """``doc, tid, cuts``: for each document with repeats its stretches (start << 24 | bytes), in order; they may overlap.

    ``docs`` has the columns of ``keyed``.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    found = scratch.saved(anchors(docs, text), "anchors")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).where("n > 1")
    twice = scratch.saved(found.join(grams.select("gram", (F.col("low") < F.col("high")).alias("mixed")), "gram"), "repeated")
    scratch.drop("anchors")
    classes = twice.where("mixed").groupBy("gram", "span").agg(F.count("*").alias("n"), F.max(F.struct("doc", "tid", "place")).alias("one"))
    classes = classes.select("gram", "span", "n", "one.doc", "one.tid", "one.place")
    runs = repeated_windows(scratch.saved(whole_spans(docs, text, classes), "spans"), scratch)
    piece = lambda place, first, last: F.shiftleft(low(place) + first, 24).bitwiseOR(last - first + LENGTH)
    settled = twice.where("not mixed").select("doc", "tid", F.array(piece(F.col("place"), F.lit(0), windows(F.col("place")))).alias("cuts"))
    within = twice.where("mixed").groupBy("gram", "span", "doc", "tid").agg(F.collect_list("place").alias("places"))  # a line may stand in a document many times
    lists = runs.groupBy("gram", "span").agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    each = F.transform("places", lambda p: F.transform("runs", lambda r: piece(p, r["first"], r["end"])))
    sorted_ = within.join(lists, ["gram", "span"]).select("doc", "tid", F.flatten(each).alias("cuts"))
    every = settled.unionAll(sorted_).groupBy("doc", "tid").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    out = saved(every.select("doc", "tid", F.sort_array(F.array_distinct("cuts")).alias("cuts")), "cuts")
    scratch.drop()
    return out


def merged(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of stretches, apart from each other; ``cuts`` is sorted by start."""
    start = cuts >> 24
    end = np.maximum.accumulate(start + (cuts & ((1 << 24) - 1)))
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], np.concatenate([end[:-1][new[1:]], end[-1:]])


def apply_cuts(data: bytes, cuts: list[int] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the bytes, and the removed stretches."""
    if not cuts:
        return data, []
    starts, ends = merged(np.array(cuts, np.int64))
    edges = [0, *[x for pair in zip(starts.tolist(), ends.tolist()) for x in pair], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), list(zip(starts.tolist(), ends.tolist()))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    Texts travel to their cuts compressed.
    """
    rows = keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "doc_id", "text")
    cuts = repeats(rows, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            n, removed, spans, sha = [], [], [], []
            for z, c in zip(b.column("z"), b.column("cuts").to_pylist()):
                data = unpack.decompress(z.as_py())
                kept, gone = apply_cuts(data, c)
                n.append(len(data))
                removed.append(len(data) - len(kept))
                spans.append(len(gone))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    out = in_arrow(squeezed(rows, "text").join(cuts, ["doc", "tid"], "left").select("doc", "z", "cuts"), run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("doc") > -(2**63), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their repeats cut out of ``text``; bytes of a character that is cut in two go with it."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = keyed(rows, "id", "text")
    cuts = repeats(rows.select("doc", "tid", "text"), "text")
    out = rows.join(cuts, ["doc", "tid"], "left").select("row", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, c in zip(b.column("text"), b.column("cuts").to_pylist()):
                t = t.as_py()
                new.append(apply_cuts(t.encode("utf-8", "surrogatepass"), c)[0].decode("utf-8", "ignore") if c else t)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(new, pa.string())], names=["row", "text"])

    done = in_arrow(out, run, f"row {out.schema['row'].dataType.simpleString()}, text string")
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
