"""Hard-negative mining over one-dimensional distance keys.

Vectors get one more component, the root of (longest norm^2 - own norm^2), so all have one norm, and a query (with 0 there) has its largest inner products with its nearest vectors: product = (|q|^2 + norm^2 - distance^2) / 2.
Each vector belongs to its nearest pivot; the store holds vectors sorted by (pivot, distance to it), cut into rings of about equal numbers, and those into blocks of at most BLOCK rows. By the triangle inequality a
ring of distances [lo, hi] around a pivot at distance d of the query holds only products between bounds that follow from d - hi, lo - d and d + hi, so a wanted range of products is a set of annuli. They are scanned
from the nearest on, each round further; what a query has found bounds what it still needs, and it ends when no ring left can hold a better one. The results are exact, whatever the pivots: recall is 1.

Pivots are fitted on a sample of SAMPLE rows, the only thing that is; every row is indexed. The directory of rings has PIVOTS * RINGS rows at any size of the data. Queries travel to the rings they ask for, packed by hundreds; nothing is broadcast
that grows with the data. A ring of any size (say of a third of all rows, all equal) is many blocks, and blocks of one ring are joined by any number of tasks.

Cases: rows with a null id, label or vector, or a null, NaN or infinite component take no part. Rows that share an id count as one: the smallest (label, vector). Shorter vectors are filled up with zeros. An anchor without other rows
of its label has no positives, a positive without a fitting negative no rows. Equal vectors and equal scores are ordered by id. Extra columns are ignored. An empty table gives an empty result. Components scaled to whole numbers
must fit 63 bits, and products as well; products of more than 52 bits are computed in whole numbers, more slowly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few_rows, materialize, scratch, table

PIVOTS, RINGS = 32, 8
SAMPLE = 512
BLOCK = 1024
#: Share of all rows that a query may have looked at after each round.
ROUNDS = (1 / 64, 1 / 8, 1.0)
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, of 100 parts of the positive's.
BAND = (50, 95)
NONE = -(1 << 62)


def whole_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, x: array<long>), one row an id, of the rows that take part. vectors: (vec_id, label, embedding)"""
    ok = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    d = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(F.forall("embedding", ok))
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("x"))
    if d.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return d
    return d.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x")


def _matrix(xs: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    size = np.diff(xs.offsets.to_numpy())
    out = np.zeros((len(xs), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = xs.flatten().to_numpy(zero_copy_only=False)
    return out


def _bytes(m: np.ndarray) -> bytes:
    small = np.abs(m).max(initial=0) < 1 << 15
    return (b"2" if small else b"8") + m.astype(np.int16 if small else np.int64).tobytes()


def _numbers(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if data[:1] == b"2" else np.int64, offset=1).reshape(-1, dim)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where all fit 52 bits."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 1 << 52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ v.astype(object).T).astype(np.int64)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


@dataclass(frozen=True)
class Index:
    """blocks: (cell, lo, hi, ids, labels, xs). cells: pivot, lo, hi and rows of each ring that has any."""

    blocks: DataFrame
    dim: int
    norm2: float
    pivots: np.ndarray
    cells: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK) -> Index | None:
        """vectors: (vec_id, label, x). Written to the shared folder; belongs to the scope around. None for no vectors."""
        square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        n, dim, norm2 = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(square)).first()
        if not n:
            return None
        dim = max(1, dim)
        sample = vectors.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow().column(0).combine_chunks()
        at = _spread(_raised(_matrix(sample, dim), norm2), pivots)
        keyed = materialize(_keyed(vectors, at, dim, norm2))
        cuts = keyed.groupBy("pivot").agg(F.percentile_approx("key", [i / rings for i in range(1, rings)]).alias("cuts"))  # a row for each pivot
        d = keyed.join(F.broadcast(cuts), "pivot").withColumn("cell", F.col("pivot") * rings + F.size(F.filter("cuts", lambda c: c < F.col("key"))))
        parts = max(1, min(10_000, -(-n // (64 * block))))
        d = d.repartitionByRange(max(parts, vectors.sparkSession.sparkContext.defaultParallelism), "cell", "key", "vec_id").sortWithinPartitions("cell", "key", "vec_id")
        blocks = materialize(_blocks(d, dim, block), keep=True)
        rows = blocks.groupBy("cell").agg(F.min("lo"), F.max("hi"), F.sum("n")).orderBy("cell").collect()
        return cls(blocks, dim, float(norm2), at, np.array([(r[0], r[0] // rings, *r[1:]) for r in rows], np.float64))

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(qid, band, vec_id, score, rank) of the k largest products in each band of each query, with vectors of its label (same) or of others, itself left out; ties by the smaller vec_id.

        queries: (qid, label, x, los: array<long>, his: array<long>), a band of products for each place of the two arrays. Written to the shared folder; belongs to the scope around.
        """
        queries = queries.repartition(max(1, min(10_000, -(-queries.count() // BLOCK))), "qid")
        with scratch(queries.sparkSession):
            queries, found = materialize(queries), None
            for i in range(len(ROUNDS)):
                asked = queries.withColumn("held", F.array().cast("array<struct<band:int,score:long>>"))
                if found is not None:
                    held = found.filter(F.col("rank") == k).groupBy("qid").agg(F.collect_list(F.struct("band", "score")).alias("h"))  # one a band
                    asked = queries.join(held, "qid", "left").withColumn("held", F.coalesce("h", F.array().cast("array<struct<band:int,score:long>>")))
                packs = materialize(self._asked(asked, i, k))
                if found is not None and packs.isEmpty():
                    break
                hits = self._hits(packs, k, same)
                hits = hits if found is None else hits.unionByName(found.drop("rank"))
                order = Window.partitionBy("qid", "band").orderBy(F.desc("score"), "vec_id")
                with few_rows(queries.sparkSession, 16):  # a row is a pack of queries and a block
                    found = materialize(hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
            return materialize(found, keep=True)

    def _asked(self, queries: DataFrame, turn: int, k: int) -> DataFrame:
        """Packs of queries for each ring of this round that may hold what they need."""
        dim, norm2, pivots, cells = self.dim, self.norm2, self.pivots, self.cells
        total = cells[:, 4].sum()
        start, end = (ROUNDS[turn - 1] if turn else -1.0) * total, ROUNDS[turn] * total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, BLOCK):
                    yield from packs(b.slice(s, BLOCK))

        def packs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            m = b.num_rows
            q = _matrix(b.column("x"), dim)
            bands = max((len(x) for x in b.column("los")), default=0)
            lo, hi, need = np.full((m, bands), 1 << 62), np.full((m, bands), NONE), np.full((m, bands), NONE)
            for i, (x, y, z) in enumerate(zip(b.column("los").to_pylist(), b.column("his").to_pylist(), b.column("held").to_pylist(), strict=True)):
                lo[i, : len(x)], hi[i, : len(y)] = x, y
                for h in z:
                    need[i, h["band"]] = h["score"]
            need = np.maximum(lo, need)  # equal scores still matter: a smaller id may stand there
            least, most = _bounds(q, norm2, pivots, cells)
            order = np.argsort(-most, axis=1, kind="stable")
            before = np.take_along_axis(np.cumsum(cells[:, 4][order], axis=1) - cells[:, 4][order], np.argsort(order, axis=1), 1)
            wanted = ((most[:, :, None] >= need[:, None]) & (least[:, :, None] <= hi[:, None])).any(2) & (before >= start) & (before < end)
            qid, label = b.column("qid").to_numpy(), b.column("label").to_numpy()
            for c in np.flatnonzero(wanted.any(0)):
                w = wanted[:, c]
                yield _batch(cell=pa.array([int(cells[c, 0])], pa.int32()), qids=[qid[w].tobytes()], qlabels=[label[w].tobytes()], qs=[_bytes(q[w])], needs=[need[w].tobytes()], his=[hi[w].tobytes()])

        return queries.select("qid", "label", "x", "los", "his", "held").mapInArrow(run, "cell int, qids binary, qlabels binary, qs binary, needs binary, his binary")

    def _hits(self, packs: DataFrame, k: int, same: bool) -> DataFrame:
        """(qid, band, vec_id, score): of each block, up to k of each band that are good enough."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    ints = lambda c: np.frombuffer(r[c], np.int64)  # noqa: B023, E731
                    qid, ids = ints("qids"), ints("ids")
                    s = _products(_numbers(r["qs"], dim), _numbers(r["xs"], dim))
                    fits = ((ints("qlabels")[:, None] == ints("labels")) == same) & (qid[:, None] != ids)
                    need, hi = ints("needs").reshape(len(qid), -1), ints("his").reshape(len(qid), -1)
                    for band in range(need.shape[1]):
                        row, col = np.nonzero(fits & (s >= need[:, band : band + 1]) & (s <= hi[:, band : band + 1]))
                        score = s[row, col]
                        order = np.lexsort((ids[col], -score, row))
                        row, col, score = row[order], col[order], score[order]
                        new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
                        nth = np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))
                        row, col, score = row[nth < k], col[nth < k], score[nth < k]
                        if len(row):
                            yield _batch(qid=qid[row], band=np.full(len(row), band, np.int32), vec_id=ids[col], score=score)

        pairs = packs.join(self.blocks.select("cell", "ids", "labels", "xs"), "cell")
        return pairs.mapInArrow(run, "qid long, band int, vec_id long, score long")


def _bounds(q: np.ndarray, norm2: float, pivots: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each query with any vector of each ring, with some room for rounding."""
    q = q.astype(np.float64)
    most = ((q**2).sum(1) + norm2)[:, None]
    d = np.sqrt(np.maximum(0, most - 2 * q @ pivots[:, :-1].T))[:, cells[:, 1].astype(int)]
    lo, hi = cells[:, 2], cells[:, 3]
    room = most * 1e-9 + 1
    gap = np.maximum(0, np.maximum(lo - d, d - hi))
    return (most - (d + hi) ** 2) / 2 - room, (most - gap**2) / 2 + room


def _raised(m: np.ndarray, norm2: float) -> np.ndarray:
    m = m.astype(np.float64)
    return np.c_[m, np.sqrt(np.maximum(0, norm2 - (m**2).sum(1)))]


def _spread(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows far from each other, each the one farthest from those before."""
    chosen, far = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def _keyed(vectors: DataFrame, pivots: np.ndarray, dim: int, norm2: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _raised(_matrix(b.column(2), dim), norm2)
            d2 = (rows**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * rows @ pivots.T
            near = d2.argmin(1)
            key = np.sqrt(((rows - pivots[near]) ** 2).sum(1))
            yield _batch(pivot=near.astype(np.int32), key=key, vec_id=b.column(0), label=b.column(1), x=b.column(2))

    return vectors.select("vec_id", "label", "x").mapInArrow(run, "pivot int, key double, vec_id long, label long, x array<long>")


def _blocks(d: DataFrame, dim: int, block: int) -> DataFrame:
    """Consecutive rows of a ring, up to `block` of them, as one row; ids ascend inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, key, ids, labels = (b.column(c).to_numpy() for c in range(4))
            x = _matrix(b.column(4), dim)
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for i in range(s, e, block):
                    j = min(e, i + block)
                    o = i + np.argsort(ids[i:j], kind="stable")
                    yield _batch(cell=cell[i : i + 1], lo=[float(key[i])], hi=[float(key[j - 1])], n=pa.array([j - i], pa.int64()), ids=[ids[o].tobytes()], labels=[labels[o].tobytes()], xs=[_bytes(x[o])])

    return d.select("cell", "key", "vec_id", "label", "x").mapInArrow(run, "cell int, lo double, hi double, n long, ids binary, labels binary, xs binary")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). vectors: (vec_id, label, x) as from whole_vectors.

    Positives: an anchor's nearest rows of its label. Negatives: for each of them, the nearest rows of other labels whose score lies within `band` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with scratch(spark):
        vectors = materialize(vectors)
        index = Index.of(vectors)
        if index is None:
            return spark.createDataFrame([], schema)
        anchors = vectors.filter(is_anchor).withColumnRenamed("vec_id", "qid")
        every = lambda v: F.array(F.lit(v).cast("long"))
        near = index.search(anchors.withColumns({"los": every(NONE), "his": every(1 << 62)}), positives, True)
        own = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("p"), F.col("vec_id").alias("positive_id")))).alias("own"))  # `positives` of them at most
        own = materialize(own)
        low, high = band
        bands = own.select("qid", F.transform("own.p", lambda p: F.ceil(p * low / F.lit(100).cast("decimal(3, 0)")).cast("long")).alias("los"), F.transform("own.p", lambda p: F.floor(p * high / F.lit(100).cast("decimal(3, 0)")).cast("long")).alias("his"))
        hard = index.search(anchors.join(bands, "qid"), negatives, False)
        out = hard.join(own, "qid").withColumn("o", F.element_at("own", F.col("band") + 1))
        out = out.select(F.col("qid").alias("anchor_id"), "o.positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("o.p").alias("positive_score"), F.col("score").alias("negative_score"))
        return materialize(out, keep=True)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = whole_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(v, F.col("vec_id") % 50 == 0)


ORACLE_OP12 = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3
"""
