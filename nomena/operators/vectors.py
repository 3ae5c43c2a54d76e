"""A vector index for largest inner products: coarse lists around centroids, residuals in one byte a component, exact re-ranking.

Centroids and scales are fitted on a bounded sample; every vector is indexed, equal vectors as one row with their smallest ids. Queries travel in packs of one home list, the blocks of the lists that a pack probes come to it one
after another, and it keeps its best few by approximate product; those are then scored exactly. Neither side is broadcast, and what a task holds is one pack and one block. Probing all lists and keeping all is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k
from .storage import batches, written

LISTS, SAMPLE, ROUNDS, BLOCK = 64, 4096, 8, 512


def _floats(c: pa.Array, dim: int) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's rounds from rows spread over the sample."""
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].astype(np.float64)
    for _ in range(ROUNDS):
        near = _nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    d = (c**2).sum(1) - 2 * x.astype(np.float64) @ c.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


@dataclass(frozen=True)
class VectorIndex:
    """distinct: (uid, ids, embedding, list), one row for equal vectors, uid the smallest id; blocks: (list, uids, codes)."""

    distinct: DataFrame
    blocks: DataFrame
    dim: int
    centroids: np.ndarray
    scale: np.ndarray
    most: int

    @classmethod
    def of(cls, vectors: DataFrame, most: int = 10, lists: int = LISTS) -> VectorIndex:
        """vectors: (vec_id, embedding: array<float>), of one length, without nulls. most: the largest number of neighbours that will be asked for."""
        dim = vectors.select(F.size("embedding")).first()[0]
        firsts = top_k(vectors.select("vec_id", "embedding"), ["embedding"], ["vec_id"], most + 1)  # cut in each task before it is shuffled
        one = firsts.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("uid"), "ids", "embedding")
        one = written(one)
        sample = one.select("uid", "embedding").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
        x = _floats(sample, dim)
        c = _centroids(x, lists)
        scale = np.maximum(np.abs(x - c[_nearest(x, c, 1)[:, 0]]).max(0) * 1.1 / 127, 1e-12)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _floats(b.column(2), dim)
                near = _nearest(v, c, 1)[:, 0]
                codes = np.clip(np.rint((v - c[near]) / scale), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(v), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())], ["uid", "ids", "embedding", "list", "code"])

        d = written(one.mapInArrow(coded, "uid long, ids array<long>, embedding array<float>, list int, code binary"))
        blocks = d.select("list", "uid", "code").repartitionByRange("list", "uid").sortWithinPartitions("list", "uid").mapInArrow(_packed, "list int, uids binary, codes binary")
        return cls(d.drop("code"), written(blocks), dim, c, scale, most)

    def neighbours(self, k: int, probes: int, keep: int | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank): of every indexed vector, the k others with the largest products among the `probes` lists nearest to it; scores are exact, rounded to five places, ties by the smaller id."""
        if k > self.most:
            raise ValueError(f"the index holds ids for {self.most} neighbours")
        keep = keep or 2 * (k + 1)
        spark, dim, c, scale = self.distinct.sparkSession, self.dim, self.centroids, self.scale
        queries = self.distinct.select("list", "uid", "embedding").repartitionByRange("list", "uid").sortWithinPartitions("list", "uid")
        with batches(spark, BLOCK):
            packs = written(queries.mapInArrow(_query_packs(dim, c, probes), "pack long, qids binary, qs binary, near binary, lists array<int>"))
        with batches(spark, 16):
            asked = packs.select("pack", F.explode("lists").alias("list")).join(self.blocks, "list").select("pack", F.lit(1).alias("kind"), "list", F.col("uids").alias("a"), F.col("codes").alias("b"), F.lit(None).cast("binary").alias("near"))
            heads = packs.select("pack", F.lit(0).alias("kind"), F.lit(-1).alias("list"), F.col("qids").alias("a"), F.col("qs").alias("b"), "near")
            both = heads.unionByName(asked).repartition("pack").sortWithinPartitions("pack", "kind")
            near = written(both.mapInArrow(_best(dim, c, scale, keep), "q long, v long"))
        e = self.distinct.select("uid", "ids", "embedding")
        pairs = near.join(e.select(F.col("uid").alias("v"), F.col("ids").alias("vids"), F.col("embedding").alias("ve")), "v").join(e.select(F.col("uid").alias("q"), F.col("embedding").alias("qe")), "q")
        product = F.aggregate(F.zip_with("qe", "ve", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
        pairs = top_k(pairs.select("q", "v", "vids", F.round(product, 5).alias("score")), ["q"], [F.desc("score"), "v"], k + 1).drop("rank")
        return pairs

    def expanded(self, pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
        """Pairs of different vectors as pairs of rows: each row of `vectors` gets its k neighbours, itself left out."""
        own = vectors.select(F.col("vec_id").alias("query_id"), "embedding").join(self.distinct.select("embedding", F.col("uid").alias("q")), "embedding").select("query_id", "q")
        d = own.join(pairs, "q").select("query_id", "score", F.explode("vids").alias("vec_id")).filter("vec_id <> query_id")
        return top_k(d, ["query_id"], [F.desc("score"), "vec_id"], k).select("query_id", "vec_id", "score", "rank")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive vectors of one list, up to BLOCK of them, as a row."""
    for b in batches:
        near, uid = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = np.flatnonzero(np.r_[True, near[1:] != near[:-1], True])
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for i in range(s, e, BLOCK):
                j = min(e, i + BLOCK)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([uid[i:j].tobytes()]), pa.array([b"".join(b.column(2).slice(i, j - i).to_pylist())])], ["list", "uids", "codes"])


def _query_packs(dim: int, c: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            q = _floats(b.column(2), dim)
            near = np.zeros((len(q), len(c)), bool)
            np.put_along_axis(near, _nearest(q, c, min(probes, len(c))), True, 1)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b.column(1).to_numpy().tobytes()]), pa.array([q.tobytes()]), pa.array([near.tobytes()]), pa.array([np.flatnonzero(near.any(0)).astype(np.int32)], pa.list_(pa.int32()))], ["pack", "qids", "qs", "near", "lists"])

    return run


def _best(dim: int, c: np.ndarray, scale: np.ndarray, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids = q = near = score = ids = None

        def given() -> Iterator[pa.RecordBatch]:
            row, col = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[row, col])], ["q", "v"])

        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if q is not None:
                        yield from given()
                    qids, q = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.float32).reshape(-1, dim)
                    near = np.frombuffer(r["near"], bool).reshape(len(qids), -1)
                    score, ids = np.full((len(q), keep), -np.inf, np.float32), np.zeros((len(q), keep), np.int64)
                    scaled = q * scale.astype(np.float32)
                    middle = q @ c.T.astype(np.float32)
                    continue
                uids, codes = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int8).reshape(-1, dim).astype(np.float32)
                rows = np.flatnonzero(near[:, r["list"]])
                s = np.concatenate([score[rows], scaled[rows] @ codes.T + middle[rows, r["list"]][:, None]], 1)
                at = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                every = np.concatenate([ids[rows], np.broadcast_to(uids, (len(rows), len(uids)))], 1)
                score[rows], ids[rows] = np.take_along_axis(s, at, 1), np.take_along_axis(every, at, 1)
        if q is not None:
            yield from given()

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 10, probes: int = 48, lists: int = LISTS) -> DataFrame:
    """(query_id, vec_id, score, rank) of every vector's k nearest others by inner product."""
    index = VectorIndex.of(vectors, k, lists)
    return index.expanded(index.neighbours(k, probes), vectors, k)
