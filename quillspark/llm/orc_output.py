"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded where they land, and written as one ORC file for each
range. ORC stores the id lists with its integer run-length encoding; its row index (minima and maxima for each
``ROW_INDEX`` rows of a stripe) and Bloom filter on ``doc_id`` let readers skip stripes, and each stripe can be read by
a task of its own. ``part`` and ``pos`` (range and place in it) keep the global order for readers that take the stripes
in any order.

Texts: null counts as empty and gives the end id only. Documents without an id come first. Equal ids stay separate
rows, ordered by the length and hash of their texts. An empty table gives files without rows.
"""

import hashlib
import json
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.common import in_arrow, saved

END_ID = 1
ROW_INDEX = 10_000
STRIPE_BYTES = 64 << 20


class _Words(dict):
    """Word to ids by the library's model; remembers words while they take at most ``most`` bytes."""

    def __init__(self, model, model_size: int, most: int):
        super().__init__()
        self.model, self.most = model, most
        self.ints = list(range(model_size))  # one object for each id
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(bpe.byte_alphabet())})

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple([self.ints[t.id] for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))])
        if self.most > 0:
            self[word] = ids
            self.most -= bpe.cost(word, ids)
        return ids


class LibraryEncoder:
    """The tokenizers library, asked once for each word that is not remembered.

    Texts in Latin-1 are cut into words by the vocabulary file's own pattern, and the library's model encodes each word;
    all other texts, and those with added tokens, go to the library as a whole.
    """

    def __init__(self, content: bytes, remembered: int = bpe.REMEMBERED):
        from tokenizers import Tokenizer

        bpe.followed(json.loads(content))
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.latin = bpe.latin_pattern()
        self.words = _Words(self.tokenizer.model, self.tokenizer.get_vocab_size(), remembered)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<" in text and any(a in text for a in self.added):
            return self.whole(text)
        return list(chain.from_iterable(map(self.words.__getitem__, self.latin.findall(text.lower()))))


def worker_encoder(content: bytes) -> LibraryEncoder:
    key = hashlib.md5(content).hexdigest()
    kept = sys.__dict__.setdefault("_quillspark_library", {})
    if key not in kept:
        kept[key] = LibraryEncoder(content)
    return kept[key]


def write(df: DataFrame, out: str, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> None:
    """Writes ``doc_id, ids, part, pos`` of every document into ORC files at ``out``, in ascending order of ids."""
    content = df.sparkSession.sparkContext.broadcast(bpe.read_spec(vocabulary))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.length("text"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, pos = worker_encoder(content.value), TaskContext.get().partitionId(), 0
        for b in batches:
            for a in range(0, b.num_rows, 1000):  # ids take more room than their text
                c = b.slice(a, 1000)
                ids = [encoder.encode(t) for t in c.column("text").to_pylist()]
                for x in ids:
                    x.append(end_id)
                n = c.num_rows
                yield pa.RecordBatch.from_pydict({"doc_id": c.column("doc_id"), "ids": bpe.id_lists(ids), "part": pa.array(np.full(n, part, np.int32)), "pos": pa.array(np.arange(pos, pos + n, dtype=np.int64))})
                pos += n

    tokens = in_arrow(dealt, run, "doc_id long, ids array<int>, part int, pos long")
    (
        tokens.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(out)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>, part int, pos long").orc(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """For each document in the files: ``doc_id, start`` (ids of all before it), ``n_tokens, ids_crc32``.

    The running sum has two levels, within a file's range and over the ranges, so no task sees all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            ends = ids.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "part": b.column("part"), "pos": b.column("pos"), "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    docs = saved(in_arrow(read(spark, path), run, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long"), "token-index")
    before = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    within = docs.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    return within.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
