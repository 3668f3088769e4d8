"""Texts as vectors, and the nearest vectors by an index of inverted lists.

A text's vector is the sum of its pieces' vectors, brought to length 1. The index deals vectors to the nearest of fitted
centres and cuts long lists into blocks; of each block it keeps how far (by angle) its farthest vector is from the centre. A
question first looks into its nearest lists. By the triangle inequality no vector of another block can be nearer than the
angle to its centre less its radius, so of the others only the blocks that could still hold a better one are looked into: the
result is that of comparing all pairs. Blocks and their questions meet in one task each, of bounded rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import search as S
from quillspark.operators.index import sent
from quillspark.operators.store import kept

#: Vectors that centres are fitted on, rounds of fitting, centres at most, rows of a block, lists looked into first.
SAMPLE, ROUNDS, CENTRES, BLOCK, PROBES = 16_384, 6, 1024, 4096, 2
#: Keeps rounding of angles from hiding a vector at the edge of its block.
SLACK = 1e-6


def embed(pieces: DataFrame, table: DataFrame, key: str = "section_id") -> DataFrame:
    """``key, v``: the sum of the vectors (``piece, vector``) of a text's ``pieces`` (key, piece), of length 1.

    Repeated pieces count as often as they stand there and are counted before the join; pieces without a vector count nothing. A
    text of which no piece is known, or whose sum is zero, has no row.
    """
    table = table.select("piece", "vector")
    first = table.select(F.size("vector")).first()
    if first is None:
        return pieces.select(key, F.array().cast("array<double>").alias("v")).limit(0)
    rows = pieces.groupBy(key, "piece").agg(F.count("*").alias("n")).join(sent(table), "piece")
    sums = rows.groupBy(key).agg(*[F.sum(F.col("n") * F.get("vector", F.lit(i)).cast("double")).alias(f"d{i}") for i in range(first[0])])
    whole = sums.select(key, F.array(*[f"d{i}" for i in range(first[0])]).alias("s"))
    return whole.where(F.exists("s", lambda x: x != 0)).select(key, S.unit(F.col("s")).alias("v"))


def centres(vectors: DataFrame, most: int = CENTRES, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors, fitted on ``SAMPLE`` of them at most (those of the lowest hashes of their ids)."""
    n = vectors.count()
    part = vectors.where(F.pmod(F.xxhash64("section_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, 1.5 * SAMPLE / max(n, 1)) * (1 << 20)) + 1))
    rows = part.orderBy(F.xxhash64("section_id")).limit(SAMPLE).select("v").collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r["v"] for r in rows], np.float64)
    k = int(min(most, max(1, np.sqrt(n) / 2), len(x)))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    return c


@dataclass
class VectorIndex:
    centres: np.ndarray
    lists: DataFrame  # list (centre and block), section_id, v
    radii: DataFrame  # list, centre, radius

    @staticmethod
    def build(vectors: DataFrame, most: int = CENTRES, block: int = BLOCK) -> "VectorIndex":
        """The index of ``vectors`` (section_id, v of length 1), in the shared folder."""
        c = centres(vectors, most)
        sent_c = vectors.sparkSession.sparkContext.broadcast(c)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
                cos = x @ sent_c.value.T if b.num_rows else np.zeros((0, 1))
                near = np.argmax(cos, axis=1) if b.num_rows else np.zeros(0, int)
                angle = np.arccos(np.clip(cos[np.arange(len(near)), near], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(angle)], ["section_id", "v", "centre", "angle"])

        of = vectors.select("section_id", F.col("v").cast("array<double>"))
        dealt = kept(of.mapInArrow(run, "section_id long, v array<double>, centre int, angle double"), "dealt")
        sizes = dealt.groupBy("centre").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row for each centre
        blocked = dealt.join(F.broadcast(sizes), "centre").withColumn("list", F.struct("centre", F.pmod(F.xxhash64("section_id"), F.col("blocks")).cast("int").alias("block")))
        lists = kept(blocked.select("list", "section_id", "v", "angle"), "lists")
        radii = kept(lists.groupBy("list").agg(F.max("angle").alias("radius")), "radii")
        return VectorIndex(c, lists.drop("angle"), radii)

    def nearest(self, queries: DataFrame, k: int, least: float = -1.0, probes: int = PROBES) -> DataFrame:
        """``qid, section_id, similarity, n``: the ``k`` nearest vectors of each query (qid, qv of length 1) with ``least`` similarity or more, equal ones by falling id."""
        if not len(self.centres):
            return queries.select("qid", F.lit(0).cast("long").alias("section_id"), F.lit(0.0).alias("similarity"), F.lit(1).alias("n")).limit(0)
        pairs = kept(self._angles(queries), "angles")
        near = Window.partitionBy("qid").orderBy("angle", "list")
        first = pairs.withColumn("n", F.row_number().over(near)).where(F.col("n") <= probes).drop("n")
        found = kept(self._inside(first, queries, k, least), "found")
        reach = found.groupBy("qid").agg(F.sort_array(F.collect_list("similarity"), False).alias("s")).select("qid", F.get("s", F.lit(k - 1)).alias("kth"))
        bound = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius") - SLACK))
        rest = pairs.join(first.select("qid", "list"), ["qid", "list"], "left_anti").join(sent(reach), "qid", "left")
        rest = rest.where((bound >= least) & (F.col("kth").isNull() | (bound >= F.col("kth"))))
        order = Window.partitionBy("qid").orderBy(F.desc("similarity"), F.desc("section_id"))
        return found.unionByName(self._inside(rest, queries, k, least)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)

    def _angles(self, queries: DataFrame) -> DataFrame:
        """``qid, list, angle`` (to the list's centre), ``radius``, of every query and block; blocks are far fewer than vectors."""
        sent_c = queries.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
                angles = np.arccos(np.clip(x @ sent_c.value.T, -1, 1)) if b.num_rows else np.zeros((0, len(sent_c.value)))
                n = len(sent_c.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(b.column(0).to_pylist(), np.int64), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), pa.array(angles.ravel())], ["qid", "centre", "angle"]
                )

        of = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>")).mapInArrow(run, "qid long, centre int, angle double")
        return of.join(sent(self.radii.withColumn("centre", F.col("list.centre"))), "centre").select("qid", "list", "angle", "radius")

    def _inside(self, pairs: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
        """The ``k`` nearest of each query within each of its lists."""

        def run(_: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(rows) and len(asked):
                x, ids = np.stack(rows["v"]).astype(np.float64), rows["section_id"].to_numpy()
                for i in range(0, len(asked), 256):
                    cos = np.stack(asked["qv"].iloc[i : i + 256]).astype(np.float64) @ x.T
                    for qid, s in zip(asked["qid"].iloc[i : i + 256], cos):
                        at = np.flatnonzero(s >= least)
                        best = at[np.lexsort((-ids[at], -s[at]))[:k]]
                        out.append(pd.DataFrame({"qid": qid, "section_id": ids[best], "similarity": s[best]}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "section_id": [], "similarity": []})

        asked = pairs.select("list", "qid").join(sent(queries.select("qid", F.col("qv").cast("array<double>"))), "qid")
        return self.lists.groupBy("list").cogroup(asked.groupBy("list")).applyInPandas(run, "qid long, section_id long, similarity double")


def keyword_sure(ranked: DataFrame) -> DataFrame:
    """``qid`` of queries whose keywords alone are sure: a strong match, a named page, a named project, or a section made for such questions."""
    top = F.col("score")
    sure = (top >= S.SURE_SCORE) | (F.col("titled") & (top >= S.SURE_TITLE_SCORE)) | F.col("of_project") | (F.col("hinted") & (top >= S.GUESS_SCORE))
    return ranked.where((F.col("rank") == 1) & sure).select("qid")


def hybrid(ranked: DataFrame, bests: S.Bests, sections: DataFrame, index: VectorIndex | None, query_vectors: DataFrame | None, limit: int = S.LIMIT) -> DataFrame:
    """``qid, rank, section_id, path, score``: keyword results, fused with those by meaning where keywords aren't sure.

    ``ranked``: what ``search.find`` shows; ``bests``: the best sections of pages. Without vectors
    (no model, or none of the query's words known) the keywords' results stay.
    """
    plain = ranked.select("qid", "rank", "section_id", "path", "score")
    if index is None or query_vectors is None:
        return plain
    both = fused(ranked, bests, sections, index, query_vectors, limit)
    asked = query_vectors.select("qid").join(keyword_sure(ranked), "qid", "left_anti")
    return plain.join(asked, "qid", "left_anti").unionByName(both.select("qid", "rank", "section_id", "path", "score"))


def fused(ranked: DataFrame, bests: S.Bests, sections: DataFrame, index: VectorIndex, query_vectors: DataFrame, limit: int = S.LIMIT) -> DataFrame:
    """The same for the queries that keywords aren't sure of alone, with ``fused``, their reciprocal ranks."""
    open_ = kept(query_vectors.join(keyword_sure(ranked), "qid", "left_anti"), "open")
    near = index.nearest(open_, S.SEMANTIC_SECTIONS, S.SEMANTIC_MIN).join(sections.select("section_id", "path"), "section_id")
    pages = Window.partitionBy("qid", "path").orderBy("n")
    one = near.withColumn("k", F.row_number().over(pages)).where("k = 1")
    meaning = one.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("n")) - 1).where(F.col("place") < S.SEMANTIC_CANDIDATES).select("qid", "path", "section_id", "similarity", "place")
    asked = open_.select("qid")
    meaning, shown = kept(meaning, "meaning"), ranked.join(asked, "qid", "left_semi")
    # only these pages can come out, so only their places among all are wanted
    keyword = bests.placed(meaning.select("qid", "path").unionAll(shown.select("qid", "path")).distinct())
    return S.fuse(keyword, shown, meaning, limit)
