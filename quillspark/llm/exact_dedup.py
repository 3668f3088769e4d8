"""Exact duplicates by a sharded cuckoo-filter index of live digests.

The index knows the texts that are live by their SHA-256. Digests are dealt to shards by their first bits; a shard is one row
with a cuckoo filter (buckets of four 16-bit fingerprints, two buckets for a digest) and the stored keys: the digests
themselves and how many live documents have each. Inserting asks the filter first. A miss is a new text for certain. A hit
is checked against the stored keys of its shard, and what is then still the same is verified on content: the texts behind
hits, and no others, are dealt to buckets by digest and compared byte for byte. A filter that overflows is built anew at
twice the size from the stored keys; when shards hold too many keys, every shard is split on further bits. Deleting takes a
document from its text's count, and the fingerprint goes with the last one, which a Bloom filter could not do.

``dedup`` inserts all documents into a new index and gives each its group. Copies are counted within map tasks before they
are shuffled, so a text that a third of all rows hold reaches its shard as one row for each task. Groups of one row need no
entry; those of more are joined to the documents by broadcast while they are few (checked), else by a shuffle in which
only groups of under 1 / ``HOT`` of all rows take part, as the at most ``HOT`` larger ones are broadcast.

Null texts count as empty texts, and all empty texts are equal. Texts of any length are taken whole. Of equal texts the row
with the largest ``doc_id`` stays; repeated rows of that id all carry its id and all count. A row without an id is kept only
if no row of its group has one; then ``keep_id`` is null. Other columns stay; columns named like the new ones are replaced.
An empty table gives no rows.
"""

from array import array
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, drop_path, in_arrow, new_path, saved

#: Fingerprints of a bucket, evictions before a filter counts as full, buckets of a new shard.
SLOTS = 4
KICKS = 500
FIRST_BUCKETS = 64
#: Keys that a shard holds on average, at most; beyond it, shards are split.
SHARD_KEYS = 1 << 16
#: Digests that a map task remembers before it sends its counts on.
COMBINED = 1 << 17
#: Groups that are broadcast; groups of at least this part of all rows are broadcast in any case.
FEW = 1 << 18
HOT = 1024

DIGEST = "_cuckoo_digest"
#: Stands for a missing id where rows are counted.
NO_ID = -(1 << 63)
_NEW = ["keep_id", "group_size", "kept", "text_sha256"]


class CuckooFilter:
    """A set of digests that may claim too much, never too little, and forgets what is removed."""

    def __init__(self, buckets: int, slots: bytes = b""):
        self.mask = buckets - 1
        self.slots = array("H", slots or bytes(2 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[12:20], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x9E3779B1 >> 7)) & self.mask

    def _put(self, bucket: int, old: int, new: int) -> bool:
        """Overwrites one slot of a bucket that holds ``old``."""
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.slots[i] == old:
                self.slots[i] = new
                return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[a * SLOTS : a * SLOTS + SLOTS] or mark in self.slots[b * SLOTS : b * SLOTS + SLOTS]

    def add(self, digest: bytes) -> bool:
        """False if no place was found; then another fingerprint was lost, and the filter must be built anew."""
        mark, a, b = self._places(digest)
        if self._put(a, 0, mark) or self._put(b, 0, mark):
            return True
        at = b
        for kick in range(KICKS):
            i = at * SLOTS + (kick + mark) % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            at = self._other(at, mark)
            if self._put(at, 0, mark):
                return True
        return False

    def remove(self, digest: bytes) -> bool:
        """To be called for digests that were added only."""
        mark, a, b = self._places(digest)
        return self._put(a, mark, 0) or self._put(b, mark, 0)


class Shard:
    """A filter with its stored keys: live digests and the number of their documents."""

    def __init__(self, buckets: int = FIRST_BUCKETS, slots: bytes = b"", digests: bytes = b"", counts: bytes = b""):
        self.filter = CuckooFilter(int(buckets), slots)
        self.live = dict(zip((digests[i : i + 32] for i in range(0, len(digests), 32)), array("q", counts)))

    def __contains__(self, digest: bytes) -> bool:
        """The filter's hits are checked against the stored keys; its misses are certain."""
        return digest in self.filter and digest in self.live

    def insert(self, digest: bytes, n: int) -> bool:
        """Whether the text was live before."""
        if digest in self:
            self.live[digest] += n
            return True
        self.live[digest] = n
        if not self.filter.add(digest):
            self.rebuild(2 * (self.filter.mask + 1))
        return False

    def delete(self, digest: bytes, n: int) -> bool:
        """Whether the text was live before."""
        if digest not in self:
            return False
        self.live[digest] -= n
        if self.live[digest] <= 0:
            del self.live[digest]
            self.filter.remove(digest)
        return True

    def rebuild(self, buckets: int) -> None:
        """A larger filter from the stored keys."""
        self.filter = CuckooFilter(buckets)
        while not all(map(self.filter.add, self.live)):
            buckets *= 2
            self.filter = CuckooFilter(buckets)

    def row(self) -> tuple[int, bytes, bytes, bytes]:
        return self.filter.mask + 1, self.filter.slots.tobytes(), b"".join(self.live), array("q", self.live.values()).tobytes()


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _shard(digest: str, bits: int) -> Column:
    """The first bits of a digest."""
    return F.shiftrightunsigned(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - bits).cast("int")


def _counted(keyed: DataFrame) -> DataFrame:
    """``digest, n, top`` (largest id): the rows of a map task counted by digest, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["digest", "n", "top"])

        for b in batches:
            for digest, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                old = seen.setdefault(digest, [0, NO_ID])
                old[0] += 1
                old[1] = max(old[1], NO_ID if doc_id is None else doc_id)
            if len(seen) >= COMBINED:
                yield out()
                seen = {}
        yield out()

    return in_arrow(keyed, run, "digest binary, n long, top long")


_STATE = "shard int, buckets int, slots binary, digests binary, counts binary"
#: What a shard's task gives out: its new state (digest null), and for each digest asked its rows here, largest id and whether it was live or came twice.
_OUT = f"{_STATE}, digest binary, n long, top long, hit boolean"


def _apply(does: str) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, state: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(*state.iloc[0][["buckets", "slots", "digests", "counts"]]) if len(state) else Shard()
        groups: dict[bytes, list] = {}
        for digest, n, top in zip(map(bytes, batch["digest"]), batch["n"].tolist(), batch["top"].tolist()):
            hit = shard.insert(digest, n) if does == "insert" else shard.delete(digest, n) if does == "delete" else digest in shard
            g = groups.setdefault(digest, [0, NO_ID, False])
            g[:] = g[0] + n, max(g[1], top), g[2] or hit or (does == "insert" and g[0] + n > 1)
        rows = [(*key, *shard.row(), None, None, None, None)] if shard.live and does != "look" else []
        rows += [(*key, None, None, None, None, d, n, None if top == NO_ID else top, hit) for d, (n, top, hit) in groups.items()]
        return pd.DataFrame(rows, columns=["shard", "buckets", "slots", "digests", "counts", "digest", "n", "top", "hit"], dtype=object)

    return run


def _split(bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """States of shards dealt anew by ``bits`` bits, each filter built from its stored keys."""

    def run(states: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in states:
            for r in rows.itertuples():
                parts: dict[int, Shard] = {}
                for digest, n in Shard(r.buckets, r.slots, r.digests, r.counts).live.items():
                    parts.setdefault(int.from_bytes(digest[:4], "big") >> (32 - bits), Shard()).insert(digest, n)
                yield pd.DataFrame([(k, *s.row()) for k, s in parts.items()], columns=["shard", "buckets", "slots", "digests", "counts"])

    return run


class CuckooIndex:
    """An index of live documents in the shared folder; ``drop`` deletes it.

    ``insert`` and ``delete`` each write a new state of the shards and add the documents to a log, from which ``groups`` tells
    the document that stays of each live text. A failed call leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] = sha256, shard_keys: int = SHARD_KEYS):
        self.spark, self.digest, self.shard_keys = spark, digest, shard_keys
        self.folder, self.bits, self.keys = new_path(spark, "cuckoo"), 0, 0
        self.state = spark.createDataFrame([], _STATE)
        self.log = spark.createDataFrame([], "digest binary, doc_id long, sign int")

    def keyed(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn(DIGEST, self.digest(F.coalesce("text", F.lit(""))))

    def _run(self, keyed: DataFrame, does: str) -> DataFrame:
        """Lets each shard take its part; gives ``digest, n, top, hit`` of the digests asked. Only a look-up leaves the state."""
        batch = _counted(keyed.select(DIGEST, F.col("doc_id").cast("long")))
        asked = batch.withColumn("shard", _shard("digest", self.bits))
        done = self.state.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_apply(does), _OUT)
        if does == "look":
            return done.select("digest", "n", "top", "hit")
        done = saved(done, "shards", path=new_path(self.spark, f"{self.folder.rsplit('/', 1)[1]}/state"))
        self.state = done.where("digest is null").select("shard", "buckets", "slots", "digests", "counts")
        return done.where("digest is not null").select("digest", "n", "top", "hit")

    def _logged(self, keyed: DataFrame, sign: int) -> None:
        rows = keyed.select(F.col(DIGEST).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(sign).alias("sign"))
        self.log = self.log.unionByName(saved(rows, "log", path=new_path(self.spark, f"{self.folder.rsplit('/', 1)[1]}/log")))

    def insert(self, docs: DataFrame, rows: int | None = None, log: bool = True) -> DataFrame:
        """Makes ``docs`` live; gives ``digest, n, top, hit`` of its texts, a row for each.

        ``rows`` is the number of documents if it is known. Texts that hit are to be verified (``differing``). ``log`` off leaves
        out the log, for an index that only serves one batch.
        """
        rows = docs.count() if rows is None else rows
        self.keys += rows
        bits = min(30, max(self.bits, (max(1, self.keys - 1) // self.shard_keys).bit_length()))
        if bits > self.bits:
            self.bits = bits
            self.state = self.state.mapInPandas(_split(bits), _STATE)
        keyed = self.keyed(docs)
        found = self._run(keyed, "insert")
        if log:
            self._logged(keyed, 1)
        return found

    def delete(self, docs: DataFrame) -> None:
        """Ends the life of ``docs`` (by id and text); those that aren't live are passed over, repeated rows count once."""
        keyed = self.keyed(docs).select("doc_id", DIGEST).dropDuplicates()
        live = self.members().select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"), "n")
        keyed = keyed.join(live, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(DIGEST) == F.col("_d"))).select("doc_id", DIGEST, "n")
        keyed = keyed.select("doc_id", DIGEST, F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")
        self._run(keyed, "delete")
        self._logged(keyed, -1)

    def members(self) -> DataFrame:
        """``digest, doc_id, n``: live documents (``n`` rows of that id and text)."""
        return self.log.groupBy("digest", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0")

    def groups(self) -> DataFrame:
        """``digest, keep_id, group_size`` of each live text."""
        return self.members().groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))

    def look_up(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``live``: whether its text is."""
        keyed = self.keyed(docs)
        live = self._run(keyed, "look").where("hit").select(F.col("digest").alias("_d"))
        return keyed.join(live, F.col(DIGEST) == F.col("_d"), "left").select(*[F.col(f"`{n}`") for n in docs.columns if n != "live"], F.col("_d").isNotNull().alias("live"))

    def drop(self) -> None:
        drop_path(self.spark, self.folder)


def _members_of(keyed: DataFrame, digests: DataFrame, n: int) -> DataFrame:
    """Rows of ``keyed`` whose digest is among ``n`` others."""
    asked = digests.select(F.col("digest").alias(DIGEST))
    return keyed.join(F.broadcast(asked) if n <= FEW else asked, DIGEST, "left_semi")


def differing(keyed: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """``digest, text, n, top`` of digests that stand for several texts (none, if digests are SHA-256).

    Texts behind hits are dealt to buckets by digest and text and compared whole; copies meet within the map tasks first.
    """
    text = F.coalesce("text", F.lit("")).alias("_t")
    same = _members_of(keyed, hits, n).groupBy(F.col(DIGEST).alias("digest"), text).agg(F.count("*").alias("n"), F.max(F.col("doc_id").cast("long")).alias("top"))
    several = same.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    return same.join(several, "digest", "left_semi")


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, few: int = FEW) -> DataFrame:
    """Adds ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to ``docs`` (with ``doc_id`` and ``text``), dropped rows included."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _NEW])
    index = CuckooIndex(spark, digest)
    rows = docs.count()
    keyed = index.keyed(docs)
    groups = scratch.saved(index.insert(docs, rows, log=False).where("hit").select("digest", "n", "top"), "groups")
    index.drop()
    n = groups.count()
    unlike = scratch.saved(differing(keyed, groups, n), "unlike") if n else groups.limit(0).withColumn("_t", F.lit(""))
    at = [F.col(f"`{c}`") for c in docs.columns]

    def given(df: DataFrame, size: Column, top: Column, alone: Column) -> DataFrame:
        keep = F.when(alone, F.col("doc_id").cast("long")).otherwise(top)
        kept = F.coalesce(F.col("doc_id").cast("long") == keep, keep.isNull() & F.col("doc_id").isNull())
        return df.select(*at, keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

    by = groups.select(F.col("digest").alias("_d"), "n", "top")
    of = F.col(DIGEST) == F.col("_d")
    size, alone = F.coalesce("n", F.lit(1).cast("long")), F.col("n").isNull()
    odd = unlike.select(F.col("digest").alias(DIGEST)).distinct()
    if n and not unlike.isEmpty():  # texts that share a digest: they are told apart by the texts themselves
        texts = unlike.select(F.col("digest").alias("_d"), F.col("_t"), "n", "top")
        apart = given(keyed.join(odd, DIGEST, "left_semi").join(texts, of & (F.coalesce("text", F.lit("")) == F.col("_t")), "left"), size, F.col("top"), alone)
        keyed = keyed.join(odd, DIGEST, "left_anti")
    else:
        apart = None
    if n <= few:
        out = given(keyed.join(F.broadcast(by), of, "left"), size, F.col("top"), alone)
    else:
        hot = by.where(F.col("n") >= max(2, rows / HOT)).select(F.col("_d").alias("_hd"), F.col("n").alias("_hn"), F.col("top").alias("_ht"))
        cold = by.where(F.col("n") < max(2, rows / HOT))
        marked = keyed.join(F.broadcast(hot), F.col(DIGEST) == F.col("_hd"), "left")
        mine = given(marked.where("_hd is not null"), F.col("_hn"), F.col("_ht"), F.lit(False))
        out = mine.unionAll(given(marked.where("_hd is null").join(cold, of, "left"), size, F.col("top"), alone))
    return out if apart is None else out.unionAll(apart)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each text, that of the largest id, with the columns of ``docs`` only."""
    found = dedup(docs).where("kept")
    out = [F.col(f"`{c}`") for c in docs.columns if c not in _NEW]
    several = found.where("group_size > 1").dropDuplicates(["text_sha256"])  # rows of one id that are repeated
    return found.where("group_size = 1").select(*out).unionAll(several.select(*out))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT doc_id, text, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM g
"""
