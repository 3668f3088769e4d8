"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits recursively: a random direction, the median of a sample's projections as the threshold, and a spill
band around it, whose vectors go to both sides. How wide the bands are, where splitting stops and how many trees there
are follow from the depth and the sample's links (``fit``), so that recall doesn't fall with size. The trees are fitted on a
bounded sample of the vectors (``SAMPLE``); every vector is indexed by every tree. A leaf of many more vectors than the
sample could split is split further by a tree fitted on a sample of its own (``SUBSAMPLE``), again and again if need be.

Within each leaf all pairs are compared, pairs at the threshold or above are verified links, and links of all trees are
united. A leaf above ``BLOCK`` vectors is cut into blocks, and each pair of blocks is compared in a task of its own: nothing
is dropped and no task holds a large leaf. Each vector carries the list of its leaves, and a link counts in the first leaf
that its ends share; so a task gives out how many links each of its vectors has there, and as links only as many as join its
vectors to components: never its pairs.

Cosines are computed in double precision, of vectors scaled by a power of two; where they come within 1e-9 of the threshold,
once more in extended precision, rounded to a double. Vectors are compared with those of their own length only. Equal
vectors are one class with a number of members: they count as linked without being compared or expanded.

Vectors that are null, of length 0, zero, or hold null or non-finite components link with nothing. A null id can take no
links: such rows keep a null component and are kept. Rows of one id with different vectors are vectors of their own, whose
components have the smallest id of all. An empty table gives no rows. Only the named columns are read, so others can't clash.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import graph
from quillspark.llm.common import Scratch, in_arrow, saved
from quillspark.llm.minhash import groups

COSINE = 0.9
TREES = 12
#: Vectors wanted in a leaf, vectors that fit the trees, and the half width of the spill band in units of a projection's
#: spread between two vectors at the threshold.
LEAF = 256
SAMPLE = 20_000
SPILL = 0.6
#: Vectors that a large leaf's own tree is fitted on, and rows that it is dealt out by.
SUBSAMPLE = 4096
PART = 50_000
#: Chance that all trees miss a link, share of a node's vectors in the band of a split, times ``trees`` at most.
MISS = 1e-3
WIDE = 0.4
MORE = 4
#: Vectors of the sample whose links are followed, links of each, and links that say something about a node.
ANCHORS = 2000
EACH = 10
FEW = 20
BLOCK = 2048
SEED = 20_240_501
#: Cosines this near to the threshold are computed again.
CLOSE = 1e-9
#: A leaf's number: its tree above these bits, below them a one and the turns to it.
TREE_BITS = 48


def near_pairs(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """(i, j) of links within the sample: of ``ANCHORS`` random vectors up to ``EACH`` random links each."""
    out = [np.zeros((0, 2), np.int64)]
    for i in rng.permutation(len(sample))[:ANCHORS]:
        near = np.flatnonzero(sample @ sample[i] >= threshold)
        near = rng.permutation(near[near != i])[:EACH]
        out.append(np.stack([np.full(len(near), i), near], axis=1))
    return np.concatenate(out)


def _means(values: np.ndarray, at: np.ndarray, nodes: int) -> np.ndarray:
    """The mean of ``values`` in each node, 0 in those without any."""
    return np.bincount(at, values, nodes) / np.maximum(np.bincount(at, minlength=nodes), 1)


Levels = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def chance(n: int, trees: int, leaf: int, miss: float = MISS) -> float:
    """The chance to separate a link that each node may have, so that all trees miss it with chance ``miss`` at the depth that n vectors need."""
    return 1 - (1 - miss ** (1 / trees)) ** (1 / max(1.0, np.ceil(np.log2(max(1.0, n / leaf)))))


def fit(sample: np.ndarray, n: int, threshold: float, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = SEED, miss: float = MISS, most: float | None = None) -> list[Levels]:
    """[tree][level]: (directions, thresholds, half bands) of its 2 ** level nodes. ``n``: vectors that will be indexed.

    A node may separate a link with chance ``most`` (see ``chance``). It takes the narrowest band that keeps to it, from ``spill`` on, by two estimates: for links at the
    threshold in any direction, and for the sample's links that reach the node. If that band would hold over ``WIDE`` of
    the node's vectors, as in a group about as tight as a link is long, the node is not split: its threshold is infinite.
    At last trees are added, up to ``MORE`` times as many, while the sample's links are missed more often than ``miss``.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    depth = max(0, int(np.ceil(np.log2(max(1.0, n / leaf)))))
    depth = min(depth, max(0, int(np.log2(max(1, len(sample) // 4)))))
    most = chance(n, trees, leaf, miss) if most is None else most
    gap = np.sqrt(2 - 2 * threshold) / np.sqrt(dims)  # spread between the projections of two vectors at the threshold
    pairs = near_pairs(sample, threshold, np.random.default_rng(seed + 1)) if depth else np.zeros((0, 2), np.int64)
    missed, forest = np.ones(len(pairs), bool), []
    while len(forest) < trees or (len(forest) < MORE * trees and missed.sum() > miss * len(pairs)):
        at, levels = np.zeros(len(sample), np.int64), []
        pair, on = np.arange(len(pairs)), np.zeros(len(pairs), np.int64)
        for level in range(depth):
            nodes = 1 << level
            directions = rng.standard_normal((nodes, dims))
            directions /= np.linalg.norm(directions, axis=1, keepdims=True)
            x = np.einsum("ij,ij->i", sample, directions[at])
            cuts = pd.Series(x).groupby(at).median().reindex(range(nodes), fill_value=0.0).to_numpy()
            away = np.abs(x - cuts[at])
            y, z = (np.einsum("ij,ij->i", sample[pairs[pair, k]], directions[on]) - cuts[on] for k in (0, 1))
            bands, found = np.zeros(nodes), np.zeros(nodes, bool)
            reached = np.bincount(on, minlength=nodes)
            for wider in (1, 1.5, 2, 3, 4):
                band = wider * spill * gap / 2
                far = (away + band) / gap
                apart = np.where(away > band, 0.5 * np.exp(-0.717 * far - 0.416 * far * far), 0.0)  # normal upper tail
                split = (np.minimum(y, z) <= -band) & (np.maximum(y, z) > band)
                fits = (_means(apart, at, nodes) <= most) & ((reached < FEW) | (_means(split, on, nodes) <= most)) & (_means(away <= band, at, nodes) <= WIDE)
                bands = np.where(fits & ~found, band, bands)
                found |= fits
            cuts = np.where(found, cuts, np.inf)
            levels.append((directions, cuts, bands))
            at = 2 * at + (x > cuts[at])
            whole, b = ~found[on], bands[on]
            left, right = whole | (np.maximum(y, z) <= b), ~whole & (np.minimum(y, z) > -b)
            pair, on = np.concatenate([pair[left], pair[right]]), np.concatenate([2 * on[left], 2 * on[right] + 1])
        missed[pair] = False
        forest.append(levels)
    return forest


def leaves(vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each leaf that a vector falls into."""
    row, at = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    for directions, cuts, bands in levels:
        x = np.einsum("ij,ij->i", vectors[row], directions[at]) - cuts[at]
        left, right = x <= bands[at], x > -bands[at]
        row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
    return row, at


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (so exactly), the largest component between a half and one."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(ids: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    """For each of n rows its ids, in order."""
    order = np.lexsort((ids, row))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[order]))


def index(nodes: DataFrame, forests: dict[int, list[Levels]]) -> DataFrame:
    """``node, size, ids``: the numbers of all leaves that a vector falls into; ``forests`` by the vectors' length."""
    known = nodes.sparkSession.sparkContext.broadcast(forests)  # per length MORE * trees * n / leaf * 2 directions at most, of the sample's depth at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                x = unit(_matrix(part.column("v")))
                rows, ids = [], []
                for tree, levels in enumerate(known.value.get(int(size), [[]])):
                    row, at = leaves(x, levels)
                    rows.append(row)
                    ids.append((tree << TREE_BITS) | (1 << len(levels)) | at)
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "size": part.column("size"), "ids": _lists(np.concatenate(ids), np.concatenate(rows), len(x))})

    return in_arrow(nodes.select("node", "size", "v"), run, "node long, size int, ids array<long>")


def split_leaves(large: DataFrame, placed: DataFrame, nodes: DataFrame, threshold: float, leaf: int, most: float, scratch: Scratch) -> DataFrame:
    """``size, id, node`` of the leaves that the leaves ``large`` (size, id, n) are split into, by a tree on a sample of each.

    A leaf that its tree leaves whole (tight groups) keeps its number.
    """
    rows = placed.join(large, ["size", "id"]).join(nodes.select("node", "v"), "node").select("size", "id", "n", "node", "v")
    rows = scratch.saved(rows.withColumn("h", F.pmod(F.xxhash64("node", "id"), F.lit(1 << 30))), "large-leaves")
    chosen = rows.where(F.col("h") < F.lit(float(1 << 30)) * (2 * SUBSAMPLE) / F.col("n"))  # twice as many as needed, whatever the leaf's size

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:  # at most some 2 * SUBSAMPLE rows
        group = group.sort_values(["h", "node"]).head(SUBSAMPLE)
        levels = fit(unit(np.array(group["v"].tolist(), dtype=np.float64)), int(group["n"].iloc[0]), threshold, 1, leaf, seed=(SEED + int(key[1])) % 2**63, miss=1.0, most=most)[0]
        return pd.DataFrame({"size": [key[0]], "id": [key[1]], "tree": [pickle.dumps(levels)]})

    trees = scratch.saved(chosen.groupBy("size", "id").applyInPandas(grow, "size int, id long, tree binary"), "small-trees")
    parts = F.ceil(F.col("n") / PART).cast("int")
    first = trees.join(large, ["size", "id"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("size", "id", "part", F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<double>").alias("v"), "tree")
    rest = rows.select("size", "id", F.pmod("h", parts).cast("int").alias("part"), "node", F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("binary").alias("tree"))
    dealt = first.unionAll(rest).repartition("size", "id", "part").sortWithinPartitions("size", "id", "part", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: Levels = []
        for b in batches:
            tree, ids = b.column("tree"), b.column("id").to_numpy()
            heads = [i for i in range(b.num_rows) if tree[i].is_valid]
            for x, y in zip([0, *heads], [*heads, b.num_rows]):
                part = b.slice(x, y - x)
                if part.num_rows and tree[x].is_valid:
                    levels = pickle.loads(tree[x].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    row, at = leaves(unit(_matrix(part.column("v"))), levels)
                    tree_, path = ids[x] >> TREE_BITS, ids[x] & ((1 << TREE_BITS) - 1)
                    whole = not levels or not np.isfinite(levels[0][1][0])
                    new = np.full(len(row), ids[x]) if whole else (tree_ << TREE_BITS) | (path << len(levels)) | at
                    yield pa.RecordBatch.from_pydict({"size": part.column("size").take(pa.array(row)), "id": pa.array(new), "node": part.column("node").take(pa.array(row))})

    return in_arrow(dealt, run, "size int, id long, node long")


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the first row of each component) after linking rows i and j."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return label


class Leaf:
    """The vectors of a leaf, or of two of its blocks, and the links that count there."""

    def __init__(self, rows: pa.Table, threshold: float):
        self.node, self.members, self.block = (rows.column(c).to_numpy() for c in ("node", "members", "block"))
        self.x = scaled(_matrix(rows.column("v").combine_chunks()))
        self.unit = unit(self.x)
        self.threshold = threshold
        self.low, self.high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        lists = rows.column("ids").combine_chunks()
        ids, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        earlier = ids < rows.column("id")[0].as_py()
        _, at, count = np.unique(ids[earlier], return_inverse=True, return_counts=True)
        place = np.empty(len(count), np.int64)
        place[np.argsort(-count, kind="stable")] = np.arange(len(count))  # leaves that most of them share come first
        at, row = place[at], row[earlier]
        self.shared = np.zeros((int((count > 1).sum()) + 63) // 64 * len(lists), np.uint64).reshape(-1, len(lists))
        use = at < 64 * len(self.shared)
        np.bitwise_or.at(self.shared, (at[use] >> 6, row[use]), np.uint64(1) << (at[use] & 63).astype(np.uint64))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links whose ends share no earlier leaf, some rows against all at a time."""
        rows, others = np.arange(len(self.node)), np.arange(len(self.node))
        if self.low != self.high:
            rows, others = np.flatnonzero(self.block == self.low), np.flatnonzero(self.block != self.low)
        for s in range(0, len(rows), 256):
            part = rows[s : s + 256]
            cosine = self.unit[part] @ self.unit[others].T
            near = cosine >= self.threshold
            for a, b in np.argwhere(np.abs(cosine - self.threshold) < CLOSE):
                near[a, b] = self.exact(part[a], others[b]) >= self.threshold
            if self.low == self.high:
                near &= part[:, None] < others[None, :]
            a, b = np.nonzero(near)
            i, j = part[a], others[b]
            for word in self.shared:
                if not len(i):
                    break
                free = (word[i] & word[j]) == 0
                i, j = i[free], j[free]
            if len(i):
                yield i, j

    def exact(self, i: int, j: int) -> float:
        x, y = self.x[i].astype(np.longdouble), self.x[j].astype(np.longdouble)
        return float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))

    def found(self) -> pa.RecordBatch:
        """``node, near, root`` of the rows with links: members of the classes linked to it here, and the first node of its component here."""
        near, label = np.zeros(len(self.node)), np.arange(len(self.node))
        for i, j in self.pairs():
            near += np.bincount(i, self.members[j], len(near)) + np.bincount(j, self.members[i], len(near))
            label = unite(label, i, j)
        has = near > 0
        return pa.RecordBatch.from_pydict({"node": pa.array(self.node[has]), "near": pa.array(near[has].astype(np.int64)), "root": pa.array(self.node[label[has]])})


CELL = ("size", "id", "low", "high")


def links(nodes: DataFrame, scratch: Scratch, threshold: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``node, near, root`` of the links found in each leaf, see ``Leaf.found``; ``nodes`` has ``node, members, size, v``."""
    sizes = {r["size"]: r["n"] for r in nodes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row for each length that occurs
    large = [k for k, n in sizes.items() if n > leaf]
    forests = {}
    if large:
        total = sum(sizes[k] for k in large)
        chosen = nodes.where(F.col("size").isin(large) & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, 1.5 * sample / total) * (1 << 30))))
        fitted: dict[int, list] = {}
        for r in chosen.orderBy(F.xxhash64("node"), "node").limit(sample).select("size", "v").collect():
            fitted.setdefault(r["size"], []).append(r["v"])
        forests = {k: fit(unit(np.array(v, dtype=np.float64)), sizes[k], threshold, trees, leaf) for k, v in fitted.items()}
    placed = scratch.saved(index(nodes, forests), "placed")
    most = min([chance(sizes[k], trees, leaf) for k in forests], default=1.0)
    one = placed.select("node", "size", F.explode("ids").alias("id"))
    settled, done = [], None
    while True:
        counts = scratch.saved(one.groupBy("size", "id").agg(F.count("*").alias("n")), "counts")
        over = counts.where(F.col("n") > 8 * max(block, leaf))
        over = over if done is None else over.join(done, ["size", "id"], "left_anti")  # those that stayed whole
        over = scratch.saved(over, "over")
        if over.isEmpty():
            break
        settled.append(one.join(over.select("size", "id"), ["size", "id"], "left_anti").select("node", "size", "id"))
        one = scratch.saved(split_leaves(over, one, nodes, threshold, leaf, most, scratch).select("node", "size", "id"), "split")
        done = over.select("size", "id") if done is None else done.unionAll(over.select("size", "id"))
    if settled:
        for more in settled:
            one = one.unionAll(more)
        placed = scratch.saved(one.distinct().groupBy("node", "size").agg(F.sort_array(F.collect_list("id")).alias("ids")), "placed-again")
        counts = scratch.saved(placed.select("size", F.explode("ids").alias("id")).groupBy("size", "id").agg(F.count("*").alias("n")), "counts-again")
    whole = placed.join(nodes.select("node", "members", "v"), "node")
    blocks = counts.select("size", "id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = whole.withColumn("id", F.explode("ids")).join(blocks, ["size", "id"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    partners = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    cells = dealt.withColumn("pair", F.explode(partners)).select("size", "id", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "block", "node", "members", "v", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, CELL):
            if group.num_rows > 1:
                yield Leaf(group, threshold).found()

    return in_arrow(cells.repartition(*CELL).sortWithinPartitions(*CELL), run, "node long, near long, root long")


def dedup(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = COSINE, **how: int) -> DataFrame:
    """One row for each vector: ``vec_id, n_links, component_id, kept``."""
    scratch = Scratch(df.sparkSession, "vectors")
    v = F.col(embedding)
    kind = df.schema[embedding].dataType.elementType.simpleString()
    v = v if kind == "float" else v.cast("array<double>")  # floats travel as they are
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(v.isNotNull() & finite, v).alias("v"))
    rows = rows.withColumn("class", F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.sha2(F.to_json("v").cast("binary"), 256)))
    members = scratch.saved(rows.select("vec_id", "class"), "members")
    nodes = rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("members"), F.first("v").alias("v"))
    nodes = scratch.saved(nodes.select("class", "first_id", "members", F.size("v").alias("size"), "v", F.monotonically_increasing_id().alias("node")), "nodes")  # written once, so that numbers stay
    found = scratch.saved(links(nodes, scratch, threshold, **how), "links")
    component = graph.components(found.where("node <> root").select("node", "root"), "node", "root", scratch)
    degree = found.groupBy("node").agg(F.sum("near").alias("near"))
    of_class = nodes.select("class", "node", "members", "first_id").join(degree, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = of_class.join(smallest, "component").select("class", (F.coalesce("near", F.lit(0)) + F.col("members") - 1).alias("n_links"), "component_id")
    out = members.join(of_class, "class", "left")
    component_id = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), component_id.eqNullSafe(F.col("vec_id")).alias("kept"))
    out = saved(out, "near-vectors")
    scratch.drop()
    return out
