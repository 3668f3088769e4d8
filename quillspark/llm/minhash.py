"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Shingles are five words in a row of the lower-cased text. Of each document's set, ``PERMUTATIONS`` minima are taken; bands
of ``ROWS`` minima each give candidates, and of each minimum only the low ``BITS`` bits are kept, packed into longs. The
number of equal slots of two signatures, corrected for chance collisions, estimates their similarity and drops hopeless
candidates (well below the threshold); those that remain are confirmed on their full sets.

Groups of copies never become all their pairs. Documents with the same words in the same order are one class (by 128 bits
of their words), of which one goes on. In each bucket the smallest node is the first; each node is tested against the first
with which it shares most bands, one pair for each node. Links that hold are joined to components, and only buckets with
several components are looked at again, cut into blocks of bounded rows and bytes, a task for each pair of blocks (none for
two blocks of one component). There, a first pass drops all rows without a promising partner in another component; the
shingle sets of the others travel to their blocks once each, where pairs are confirmed while their ends are still apart,
each in the first band that they share. Of the links found only those come out that join components of the task: fewer than
it has rows, however many pairs are alike.

Texts without words have an empty set and link with nothing; with fewer than five words the whole sequence is the one
shingle. Null texts count as empty. Rows without an id can take no links: their component is null, and they are kept.
Rows of one id with the same words are one document; with other words they are documents of their own, each with its own
links, and ``keep_one`` keeps a component once. Words of any length and texts of any length are taken whole. An empty table
gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import graph
from quillspark.llm.common import Scratch, in_arrow, saved

SHINGLE = 5
SIMILARITY = (75, 100)
PERMUTATIONS = 768
#: The first minima make BANDS bands of ROWS: two sets at similarity .75 share a band with probability 1 - 5e-6.
BANDS = 32
ROWS = 4
BITS = 2
#: Standard errors below the threshold at which an estimate drops a candidate.
MARGIN = 4.0
SEED = 1_000_003
#: Shingles permuted at once.
CHUNK = 256
#: Rows of a bucket, and bytes of their shingle sets, that make a block; larger buckets are compared by pairs of blocks.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
#: Parts of a hot first node's rows, and bytes of shingle sets that a task remembers.
SALTS = 64
KNOWN_BYTES = 16 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiplicative hash, on uint64 (wraps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    """Runs without white space, with A to Z lower-cased; bytes.split and bytes.lower know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(tokens: list[bytes]) -> np.ndarray:
    """The distinct hashes (sorted, 64 bits) of the shingle set."""
    import xxhash

    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for j in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each permutation of 32-bit numbers the minimum over the set."""
    out = np.full(PERMUTATIONS, np.uint32(2**32 - 1))
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(high), CHUNK):
        permuted = high[s : s + CHUNK, None] * a
        permuted += b
        np.minimum(out, permuted.min(axis=0), out=out)
    return out.astype(np.uint64)


def packed(mins: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum (mixed, as minima lie low), as signed longs."""
    low = _mix(mins) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shift = (np.arange(per) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(-1, per) << shift, axis=1).view(np.int64)


def bands(mins: np.ndarray) -> np.ndarray:
    rows = mins[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def digest(tokens: list[bytes]) -> tuple[int, int] | tuple[None, None]:
    """128 bits of the word sequence, as two signed longs; none without words."""
    import xxhash

    if not tokens:
        return None, None
    h = xxhash.xxh3_128_digest(b" ".join(tokens))
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


LONGS = PERMUTATIONS * BITS // 64
SIGNATURE = [f"s{i}" for i in range(LONGS)]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, tid, text``: an id and 64 bits of the text tell rows apart, but for repeated ones."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tid"), F.col(text).alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, tid, n_shingles, h, l`` (128 bits of the word sequence; null without words), ``s0`` ... and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations()
        for c in batches:
            n, high, low, sig, keys = [], [], [], [], []
            for t in c.column("text"):
                tokens = words(t.as_py())
                s = shingles(tokens)
                n.append(len(s))
                h, l = digest(tokens)
                high.append(h)
                low.append(l)
                m = minima(s, a, b) if len(s) else np.zeros(PERMUTATIONS, np.uint64)
                sig.append(packed(m))
                keys.append(bands(m))
            sig, flat = np.array(sig).reshape(-1, LONGS), np.concatenate([*keys, np.zeros(0, np.int64)])
            cols = {"doc_id": c.column("doc_id"), "tid": c.column("tid"), "n_shingles": pa.array(n, pa.int64()), "h": pa.array(high, pa.int64()), "l": pa.array(low, pa.int64())}
            cols |= {k: pa.array(np.ascontiguousarray(sig[:, i])) for i, k in enumerate(SIGNATURE)}
            yield pa.RecordBatch.from_pydict(cols | {"bands": pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32)), pa.array(flat))})

    return in_arrow(docs.select("doc_id", "tid", "text"), run, f"doc_id long, tid long, n_shingles long, h long, l long, {', '.join(f'{k} long' for k in SIGNATURE)}, bands array<long>")


def estimate(x: str, y: str) -> Column:
    """Collision-corrected similarity of the packed signatures in columns x0 ... and y0 ..."""
    slots = sum(1 << (BITS * i) for i in range(64 // BITS))
    slots -= (slots >> 63) << 64
    apart = F.lit(0)
    for i in range(LONGS):
        d = F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))
        any_bit = d
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, k))
        apart = apart + F.bit_count(any_bit.bitwiseAND(F.lit(slots)))
    equal, chance = 1 - apart / PERMUTATIONS, 0.5**BITS
    return (equal - chance) / (1 - chance)


def least_estimate() -> float:
    chance = 0.5**BITS
    j = SIMILARITY[0] / SIMILARITY[1]
    p = chance + (1 - chance) * j
    return j - MARGIN * (p * (1 - p) / PERMUTATIONS) ** 0.5 / (1 - chance)


def linked(both: int | np.ndarray, x: int | np.ndarray, y: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of x and y shingles that share ``both`` are similar enough; exact."""
    part, whole = SIMILARITY
    return whole * both >= part * (x + y - both)


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose estimate is not hopeless."""
    of = lambda k, p: nodes.select(F.col("node").alias(k), *[F.col(s).alias(f"{p}{i}") for i, s in enumerate(SIGNATURE)])
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where(estimate("x", "y") >= least_estimate()).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` that are linked by the full shingle sets of ``texts`` (node, text).

    Rows of one ``a`` follow its own text in a partition sorted by it; a hot ``a`` is split by a salt of ``b``, its text
    copied to each part.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    first = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rest = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    rows = first.unionAll(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_set = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, b, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text")):
                s = shingles(words(t.as_py()))
                if b is None:
                    own, own_set = a, s
                    continue
                assert own == a
                if linked(len(np.intersect1d(own_set, s, assume_unique=True)), len(own_set), len(s)):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return in_arrow(rows, run, "a long, b long")


def _labelled(rows: DataFrame, component: DataFrame, node: str = "node") -> DataFrame:
    """Adds ``c_node``: the component of the node (itself if it has no link yet)."""
    own = component.select(F.col("node").alias(node), F.col("component").alias("c_node"))
    return rows.join(own, node, "left").withColumn("c_node", F.coalesce("c_node", node))


CELL = ("key", "low", "high")


def cells(buckets: DataFrame, component: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of buckets with several components, dealt to cells: ``key, low, high`` (bucket and its two blocks), ``block, node, c_node, n, bands, s0`` ...

    A component that fills a block has blocks of its own, as it needs no comparison with itself; the others share theirs.
    """
    load = F.lit(1.0 / BLOCK) + F.col("n") * (8.0 / BLOCK_BYTES)
    rows = scratch.saved(_labelled(buckets.select("key", "node", "n"), component).withColumn("load", load), "labelled")
    runs = rows.groupBy("key", "c_node").agg(F.sum("load").alias("load")).withColumn("own", F.when(F.col("load") >= 1, F.ceil("load")).cast("long"))
    shared = F.ceil(F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("load"))), F.lit(0.0))).cast("long")
    mixed = runs.groupBy("key").agg(F.min("c_node").alias("low"), F.max("c_node").alias("high"), F.coalesce(F.sum("own"), F.lit(0)).alias("owned"), shared.alias("shared"))
    mixed = mixed.where("low < high").select("key", "owned", "shared")
    before = Window.partitionBy("key").orderBy("c_node").rowsBetween(Window.unboundedPreceding, -1)
    large = runs.where("own is not null").select("key", "c_node", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    rows = rows.select("key", "node", "c_node").join(mixed, "key").join(large, ["key", "c_node"], "left")
    at = F.when(F.col("own").isNotNull(), F.col("offset") + F.pmod(F.xxhash64("node"), "own")).otherwise(F.col("owned") + F.pmod(F.xxhash64("node"), F.greatest("shared", F.lit(1))))
    rows = rows.withColumn("block", at.cast("int"))
    partners = F.filter(F.sequence(F.lit(0), (F.col("owned") + F.col("shared") - 1).cast("int")), lambda o: F.col("own").isNull() | (o < F.col("offset")) | (o >= F.col("offset") + F.col("own")))
    rows = rows.withColumn("other", F.explode(partners)).select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "c_node")
    return rows.join(nodes.select("node", "n", "bands", *SIGNATURE), "node")


class Cell:
    """The rows of a cell, and which pairs of them this cell has to look at."""

    def __init__(self, rows: pa.Table):
        self.node, self.own, self.block, self.n = (rows.column(c).to_numpy() for c in ("node", "c_node", "block", "n"))
        self.sig = np.stack([rows.column(c).to_numpy() for c in SIGNATURE], axis=1).view(np.uint64)
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.band = int(np.argmax(self.bands[0] == rows.column("key")[0].as_py()))
        self.same = rows.column("low")[0] == rows.column("high")[0]
        self.least = least_estimate()

    def partners(self, i: int, label: np.ndarray) -> np.ndarray:
        """Later rows of another label that may be similar to row i and share no earlier band with it."""
        j = np.arange(i + 1, len(self.node))
        j = j[(label[j] != label[i]) & (self.same | (self.block[j] != self.block[i]))]
        if len(j):  # the smaller set as the intersection, the larger as the union, at best
            j = j[linked(np.minimum(self.n[j], self.n[i]), self.n[j], self.n[i])]
        if len(j):
            j = j[similarity(self.sig[i], self.sig[j]) >= self.least]
        if len(j):
            j = j[~(self.bands[j, : self.band] == self.bands[i, : self.band]).any(axis=1)]
        return j


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def candidates(rows: DataFrame) -> DataFrame:
    """The rows of ``cells`` that have a promising partner of another component in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, CELL):
            cell = Cell(group)
            wanted = np.zeros(len(cell.node), bool)
            for i in range(len(wanted) - 1):
                j = cell.partners(i, cell.own)
                wanted[j] = True
                wanted[i] |= len(j) > 0
            if wanted.any():
                yield from group.filter(pa.array(wanted)).combine_chunks().to_batches()

    return in_arrow(dealt(rows), run, rows.schema)


def spanning(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the components of each cell as its confirmed pairs do; ``sets`` has ``node, shingles``."""

    def joined(group: pa.Table) -> tuple[list[int], list[int]]:
        cell = Cell(group)
        _, label = np.unique(cell.own, return_inverse=True)
        flat = np.frombuffer(b"".join(group.column("shingles").to_pylist()), np.uint64)
        _, ids = np.unique(flat, return_inverse=True)
        end = np.cumsum(cell.n)
        begin = end - cell.n
        mark = np.zeros(len(ids), bool)
        out_a, out_b = [], []
        for i in range(len(label) - 1):
            j = cell.partners(i, label)
            if not len(j):
                continue
            mark[ids[begin[i] : end[i]]] = True
            size = cell.n[j]
            first = np.cumsum(size) - size
            hits = mark[ids[np.repeat(begin[j] - first, size) + np.arange(size.sum())]]
            both = np.add.reduceat(hits, first, dtype=np.int64)
            mark[ids[begin[i] : end[i]]] = False
            for k in j[linked(both, size, cell.n[i])]:
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    out_a.append(int(cell.node[i]))
                    out_b.append(int(cell.node[k]))
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, CELL):
            a, b = joined(group)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_arrow(dealt(rows.join(sets, "node")), run, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal values of ``by``, one after another."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy() for c in by]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(rest) and any(rest[-1].column(c)[-1] != b.column(c)[0] for c in by)
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if rest and (x or new[0]):
                yield pa.Table.from_batches(rest)
                rest = []
            if y > x:
                rest.append(b.slice(x, y - x))
    if rest:
        yield pa.Table.from_batches(rest)


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``estimate`` of one packed signature and each row of others."""
    d = x ^ y
    any_bit = d.copy()
    for k in range(1, BITS):
        any_bit |= d >> np.uint64(k)
    slots = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    equal = 1 - np.bitwise_count(any_bit & slots).sum(axis=-1, dtype=np.int64) / PERMUTATIONS
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node, shingles``: the sorted 64-bit hashes of each node's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(words(t.as_py())).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "shingles": pa.array(sets, pa.binary())})

    return in_arrow(texts.select("node", "text"), run, "node long, shingles binary")


def components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``keyed`` rows: (a row ``doc_id, n_shingles, component_id`` for each document; ``doc_id, tid`` of the one that stays of each component)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.saved(signatures(docs), "signatures")
    members = rows.where("h is not null and doc_id is not null")
    classes = members.groupBy("h", "l").agg(F.min(F.struct("doc_id", "tid")).alias("one")).select("h", "l", "one.*")
    classes = scratch.saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so that numbers stay
    nodes = members.join(classes, ["h", "l", "doc_id", "tid"]).dropDuplicates(["node"])
    nodes = scratch.saved(nodes.select("node", "doc_id", "tid", F.col("n_shingles").alias("n"), "bands", *SIGNATURE), "nodes")
    keyed_ = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed_.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    buckets = scratch.saved(keyed_.join(shared.select("key", "first"), "key"), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("doc_id", "tid", "node")
    texts = scratch.saved(docs.join(wanted, ["doc_id", "tid"]).select("node", "text").dropDuplicates(["node"]), "texts")

    # Each node with the first node that it shares most bands with; then what is still apart, block by block.
    bands_ = buckets.where("node > first").groupBy("node", "first").agg(F.count("*").alias("shared"))
    best = bands_.groupBy("node").agg(F.max(F.struct("shared", F.col("first").alias("a"))).alias("m")).select(F.col("m.a").alias("a"), F.col("node").alias("b"))
    links = scratch.saved(confirmed(scratch.saved(promising(best, nodes), "pairs"), texts), "confirmed")
    component = graph.components(links, scratch=scratch)
    found = scratch.saved(candidates(cells(buckets, component, nodes, scratch)), "candidates")
    if not found.isEmpty():
        sets = shingle_sets(texts.join(found.select("node").distinct(), "node", "left_semi"))
        more = scratch.saved(spanning(found, sets), "spanning")
        component = graph.components(links.unionAll(more), scratch=scratch)

    whole = _labelled(classes.select("h", "l", "node", "doc_id", "tid"), component)
    smallest = whole.groupBy("c_node").agg(F.min(F.struct("doc_id", "tid")).alias("stays"))
    named = whole.select("h", "l", "c_node").join(smallest, "c_node").select("h", "l", F.col("stays.doc_id").alias("component_id"))
    out = saved(rows.select("doc_id", "n_shingles", "h", "l").join(named, ["h", "l"], "left").select("doc_id", "n_shingles", "component_id"), "near-duplicates")
    stay = saved(smallest.select("stays.*"), "staying")
    scratch.drop()
    return out, stay


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id, kept``."""
    out, _ = components_of(keyed(docs, doc_id, text))
    id_ = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", id_.alias("component_id"), id_.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document of the smallest id, once.

    Rows without words or without an id stay. Of rows with the same id and text, that of the smallest hash of all columns stays.
    """
    _, stay = components_of(keyed(docs, doc_id, text))
    t = F.col(text)
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("tid"), F.coalesce(t.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words"))
    free = rows.where("not _words or doc_id is null").select("row.*")
    once = rows.where("_words and doc_id is not null").join(stay, ["doc_id", "tid"]).groupBy("doc_id", "tid").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return free.unionAll(once.select("row.*"))
