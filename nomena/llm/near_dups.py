"""N-gram Jaccard join by PartEnum signatures, exact: no pair over the threshold is lost.

A document's set holds the distinct shingles of its words. Sets fall into size bands such that a linked pair lies in one band or
two neighbouring ones, so a set takes part in its own band and the next. Linked sets of a band differ in at most K shingles. Its shingle domain is dealt
to n1 parts of n2 subparts each, with 2 * n1 > K: in some part a linked pair differs in at most one shingle, so all
subparts of it but one agree. Every subset of n2 - 1 subparts of each part gives a signature, a hash of the set's shingles there;
linked pairs share one. What shares a signature is verified by its whole sets.

Copies (equal word strings) are one node. Then come rounds in which each node is compared with one other at most: of another component than its own so far,
and the one that it shares most signatures with, so a large group of near copies needs about as many comparisons as it has nodes. Only nodes of signatures that
are still apart afterwards are compared in all pairs, by parity sketches first. Nodes that sketches leave together make clusters, of which only joining edges are passed on; inside a
cluster's blocks whole sets are compared where sketches rule nothing out. So nodes and links that join components are passed on, never pairs of a group. Signatures are matched in packed buckets whose number grows with the data; a batch of documents passes on one
row of a signature at most, so no signature fills a bucket.

Cases: null texts and texts without words have an empty set and link with nothing; a text of fewer words than a shingle has one shingle, the whole; null doc_ids
take part and are larger than any id in a component's smallest id (null if it has no other); repeated rows each get an output row; extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, Words, discard, materialize, mix64, run_hashes, scratch, table

#: Signature rows in a bucket, about: what one task sorts at a time.
BUCKET_ROWS = 1_000_000
#: Sets that are compared with each other at a time, and their shingles: a task holds two such blocks at most.
BLOCK, BLOCK_SHINGLES = 2000, 1_000_000
#: Numbers of a matrix of sketches at a time.
CELLS = 1 << 21
#: Nodes of a signature whose sketches are compared in one pass over all signatures; those of more nodes go in blocks.
FEW = 1000
#: Signatures a shingle that are shuffled at a time, about: there are as many passes over the texts as that asks for, each for an equal part of the signatures.
A_PASS = 0.2
#: Rounds of one comparison a node, at most; they end with the first that finds no link.
ROUNDS = 2
#: Nodes that a node is compared with in a round, at most: those it shares most signatures with.
TRIES = 4
#: Pairs of a node whose sketches are compared in a round, at most: those of most shared signatures; the others stay for later.
LOOKED = 8
#: Copies of a join's small side where its key may be held by most rows of the other.
SALTS = 16
#: Most rows of a few numbers that are broadcast (some 30 MB); beyond it both sides are joined through a shuffle.
SENT = 500_000
#: Edges in a written file, about.
EDGES = 100_000
#: Parts beyond those needed, so that empty subsets need no signature.
SPARE = 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(codes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of n words; of fewer words, the hash of all of them."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    if len(codes) < n:
        return run_hashes(codes, len(codes)) ^ np.uint64(len(codes))
    return np.unique(run_hashes(codes, n))


class PartEnum:
    """Signatures of sets for a Jaccard similarity of at least p / q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.tops = [q // p if q // p > 1 else 1]  # the largest size of each band; band i begins after band i - 1

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, (self.tops[-1] + 1) * self.q // self.p))
        return int(np.searchsorted(self.tops, size))

    def most(self, band: int) -> int:
        """Shingles in which two linked sets of a band differ at most."""
        while len(self.tops) <= band:
            self.band(self.tops[-1] + 1)
        return (self.q - self.p) * 2 * self.tops[band] // (self.q + self.p)

    def parts(self, band: int) -> tuple[int, int, int]:
        """(n1, n2, spare). Subparts that would hold few shingles are made three to a part, so a subset has twice as many."""
        k = self.most(band)
        if k == 0:
            return 1, 1, 0
        spare = SPARE if k >= 16 else 0
        return k // 2 + 1 + spare, 2 if k >= 16 and self.tops[band] >= 8 * (k + 2) else 3, spare

    def signatures(self, found: np.ndarray) -> np.ndarray:
        """found: distinct hashes. 64-bit signatures for the set's band and the next.

        Empty subsets of shingles agree in many sets that have nothing in common. With `spare` parts more than needed, 1 + spare parts
        of a linked pair differ in one shingle at most; if no more than spare parts of a set have an empty subset, the pair agrees in
        one that isn't empty, and the empty ones need no signature.
        """
        if not len(found):
            return np.zeros(0, np.uint64)
        own = self.band(len(found))
        out = []
        for band in (own, own + 1):
            n1, n2, spare = self.parts(band)
            salt = mix64(np.array([band + 1], np.uint64) * _GOLD)
            h = mix64(found ^ salt)
            m = n1 * n2
            slot = (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, slot, mix64(h * _GOLD))
            keys, many = sums.reshape(n1, n2), np.bincount(slot, minlength=m).reshape(n1, n2)
            if n2 > 1:  # all subparts of a part but one
                keys, many = keys.sum(1, keepdims=True, dtype=np.uint64) - keys, many.sum(1, keepdims=True) - many
            empty = many == 0
            keys = mix64(keys.ravel() ^ mix64((np.arange(m, dtype=np.uint64) + np.uint64(1)) * _GOLD + salt))
            out.append(keys[~empty.ravel()] if spare and empty.any(1).sum() <= spare else keys)
        return np.concatenate(out)


def _node(codes: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 63-bit halves of a digest of the word string."""
    d = hashlib.md5(b"%d " % seed + codes.tobytes()).digest()
    return int.from_bytes(d[:8], "big") >> 1, int.from_bytes(d[8:], "big") >> 1


def _sent(rows: DataFrame) -> DataFrame:
    """Written rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _members(docs: DataFrame, n: int, p: int, q: int, seed: int) -> DataFrame:
    """(doc_id, row, node, check, n_shingles, n_words, sketch) of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for b in batches:
            out, words = [], Words(list(b["text"]), memo)
            for i, (doc_id, row) in enumerate(zip(b["doc_id"], b["row"], strict=True)):
                w = words.of(i)
                found = shingles(w, n)
                out.append((doc_id, row, *_node(w, seed), len(found), len(w), sketch(found, sketch_bits(len(found), p, q))))
            yield pd.DataFrame(out, columns=["doc_id", "row", "node", "check", "n_shingles", "n_words", "sketch"])

    out = docs.mapInPandas(run, "doc_id string, row string, node long, check long, n_shingles long, n_words long, sketch binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _shared_signatures(docs: DataFrame, n: int, p: int, q: int, seed: int, buckets: int, turn: int, turns: int) -> DataFrame:
    """(sig, node) of all signatures of this turn that two nodes or more have; a row may come twice."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        scheme = PartEnum(p, q)
        for b in batches:
            nodes: dict[int, np.ndarray] = {}
            words = Words(list(b["text"]), memo)
            for w in map(words.of, range(len(b))):
                if len(w) and (k := _node(w, seed)[0]) not in nodes:
                    nodes[k] = scheme.signatures(shingles(w, n))
            if not nodes:
                continue
            sig = np.concatenate(list(nodes.values()))
            # 40 bits and the bucket are left of a signature: a chance collision adds a candidate, it loses none
            sig = (sig % np.uint64(buckets)) << np.uint64(40) | sig >> np.uint64(24)
            node = np.repeat(np.fromiter(nodes, np.int64, len(nodes)), [len(x) for x in nodes.values()])
            mine = (sig >> np.uint64(40)) % np.uint64(turns) == turn
            sig, node = sig[mine], node[mine]
            if not len(sig):
                continue
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            fresh = np.r_[True, sig[1:] != sig[:-1]]
            within = ~fresh | np.r_[~fresh[1:], False]
            out = []
            if within.any():  # signatures that the batch itself has twice are shared: they are known now
                out.append((int(sig[0] >> np.uint64(40)), True, np.stack([sig[within].view(np.int64), node[within]]).tobytes()))
            sig, node = sig[fresh], node[fresh]
            where = (sig >> np.uint64(40)).astype(np.int64)  # sorted, as sig is
            edge = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                kinds, local = np.unique(node[a:z], return_inverse=True)  # a node is named once, its rows by 16 bits
                out.append((int(where[a]), False, np.int64(len(kinds)).tobytes() + kinds.tobytes() + sig[a:z].astype(np.uint32).tobytes() + (sig[a:z] >> np.uint64(32)).astype(np.uint8).tobytes() + local.astype(np.uint16).tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "known", "blob"])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def give(sig: np.ndarray, node: np.ndarray) -> Iterator[pd.DataFrame]:
            for a in range(0, len(sig), 100_000):
                yield pd.DataFrame({"sig": sig[a : a + 100_000], "node": node[a : a + 100_000]})

        def bucket(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
            if held:
                sig, node = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                apart = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
                sig, node = sig[apart], node[apart]
                fresh = np.r_[True, sig[1:] != sig[:-1]]
                shared = ~fresh | np.r_[~fresh[1:], False]
                yield from give(sig[shared].view(np.int64), node[shared])

        now, held = None, []
        for b in batches:
            for k, known, blob in zip(b["bucket"], b["known"], b["blob"], strict=True):
                if known:
                    pair = np.frombuffer(blob, np.int64).reshape(2, -1)
                    yield from give(pair[0], pair[1])
                    continue
                if k != now:
                    yield from bucket(held)
                    now, held = k, []
                m = int(np.frombuffer(blob, np.int64, 1)[0])
                rows, at = (len(blob) - 8 - 8 * m) // 7, 8 + 8 * m
                kinds = np.frombuffer(blob, np.int64, m, 8)
                sig = np.frombuffer(blob, np.uint32, rows, at).astype(np.uint64) | np.frombuffer(blob, np.uint8, rows, at + 4 * rows).astype(np.uint64) << np.uint64(32) | np.uint64(int(k) << 40)
                held.append((sig, kinds[np.frombuffer(blob, np.uint16, rows, at + 5 * rows)]))
        yield from bucket(held)

    packed = docs.select("text").mapInPandas(cut, "bucket int, known boolean, blob binary")
    by = packed.repartition(-(-buckets // turns), "bucket").sortWithinPartitions("bucket")
    return by.mapInPandas(match, "sig long, node long")


def sketch_bits(size: int, p: int, q: int) -> int:
    """A power of two, four times the shingles in which linked sets of that size may differ, or more."""
    return max(64, 1 << (4 * ((q - p) * 2 * size // (q + p)) - 1).bit_length()) if size else 64


def sketch(found: np.ndarray, bits: int) -> bytes:
    """Parities of the set's shingles by `bits` classes: two sets differ in no fewer shingles than their sketches do in bits."""
    place = (mix64(found.view(np.uint64) ^ _GOLD) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _near(x: int, nx: int, y: int, ny: int, p: int, q: int) -> bool:
    """False only if sets of sizes nx and ny with these sketches (as whole numbers) can't be linked."""
    if min(nx, ny) * q < max(nx, ny) * p:
        return False
    a, b = sketch_bits(nx, p, q), sketch_bits(ny, p, q)
    while a > b:
        a //= 2
        x = (x >> a) ^ (x & ((1 << a) - 1))
    while b > a:
        b //= 2
        y = (y >> b) ^ (y & ((1 << b) - 1))
    return (x ^ y).bit_count() * (q + p) <= (q - p) * (nx + ny)


def _stars(at: DataFrame, info: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, n): for each node b of a signature one node a of another component, unless size or sketch rules a link out; n: signatures they share so; and the pairs (a, b) that were looked at. at: (sig, node, comp, lo, hi), info: (node, size, sketch).

    a is a node of the signature's smallest component, or of its largest one. A node of a large group may meet another a in each of its signatures: of its pairs LOOKED are looked at, so there are at most so many a node.
    """
    pairs = at.select(F.when(F.col("comp") == F.col("lo.comp"), F.col("hi.node")).otherwise(F.col("lo.node")).alias("a"), F.col("node").alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    turn = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    pairs = materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("turn", turn).filter(F.col("turn") <= LOOKED).drop("turn"))
    end = lambda x: info.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"x{x}"))
    met = _salted(pairs, end("a"), "a", "b").join(end("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            near = [_near(int.from_bytes(xa, "little"), na, int.from_bytes(xb, "little"), nb, p, q) for na, xa, nb, xb in zip(d["na"], d["xa"], d["nb"], d["xb"], strict=True)]
            yield d.loc[np.array(near, bool), ["a", "b", "n"]]

    return met.mapInPandas(run, "a long, b long, n long"), pairs.select("a", "b")


def _best(near: DataFrame) -> DataFrame:
    """(a, b): of each b the TRIES pairs with most shared signatures."""
    top = F.slice(F.sort_array(F.collect_list(F.struct("n", (-F.col("a")).alias("a"))), asc=False), 1, TRIES)
    return near.groupBy("b").agg(top.alias("ts")).select("b", F.explode("ts").alias("t")).select((-F.col("t.a")).alias("a"), "b")


def _salted(rows: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """rows, written, with the columns of `small`, which has one row for each key; most rows may have one key, so small is joined in SALTS copies, by the digest of `spread`."""
    small = small.join(_sent(materialize(rows.select(key).distinct())), key, "left_semi")
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("__salt", salt).join(copies, [key, "__salt"]).drop("__salt")


class _Forest:
    """Clusters of nodes, with the edges that made them: at most one a node."""

    def __init__(self) -> None:
        self.over: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        over = self.over
        while (up := over.setdefault(x, x)) != x:
            over[x] = over[up]
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.over[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.edges, columns=["a", "b"], dtype="int64")


def _hopeful_few(at: DataFrame, info: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): edges that put the nodes of every pair of one signature and two components, whose sketches don't rule a link out, in one cluster; at: (sig, node, comp), info: (node, size, sketch).

    A task passes on fewer edges than it has nodes, however many pairs there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, now, held = _Forest(), None, []

        def compare() -> None:
            held.sort()  # by component
            if len(held) > 12:
                comp, node, size = (np.array([h[x] for h in held], np.int64) for x in range(3))
                kinds, many = np.unique(comp, return_counts=True)
                left = comp != kinds[np.argmax(many)]
                twice = lambda x: np.concatenate([x[left], x])
                k, bits = int(left.sum()), [h[3] for h in held]
                bits = [bits[i] for i in np.flatnonzero(left)] + bits
                name = twice(node)
                for a, b, near in _close(bits, twice(size), twice(comp), np.arange(len(bits)) < k, p, q):
                    _join_near(forest, name[a], name[b], near)
                return
            for i, (ca, a, na, xa) in enumerate(held):
                for cb, b, nb, xb in held[i + 1 :]:
                    if ca != cb and forest.top(a) != forest.top(b) and _near(int.from_bytes(xa, "little"), na, int.from_bytes(xb, "little"), nb, p, q):
                        forest.join(a, b)

        for batch in batches:
            for sig, node, comp, size, bits in zip(batch["sig"], batch["node"], batch["comp"], batch["size"], batch["sketch"], strict=True):
                if sig != now:
                    compare()
                    now, held = sig, []
                held.append((comp, node, size, bits))
            if len(forest.over) > 500_000:
                yield forest.frame()
                forest = _Forest()
        compare()
        yield forest.frame()

    d = at.join(info, "node").select("sig", "node", "comp", "size", "sketch")
    return d.repartition("sig").sortWithinPartitions("sig").mapInPandas(run, "a long, b long")


def _join_near(forest: _Forest, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
    """Joins a[i] and b[j] wherever near[i, j]: a row's columns with the row's first one, so each takes part once a row."""
    top = np.array([forest.top(x) for x in b.tolist()], np.int64)
    for i in np.flatnonzero(near.any(1)).tolist():
        x = int(a[i])
        own = forest.top(x)
        for j in np.flatnonzero(near[i] & (top != own)).tolist():
            forest.join(x, int(b[j]))
            top[j] = own = forest.top(x)


def _sets(docs: DataFrame, nodes: DataFrame, n: int, seed: int, once: bool) -> DataFrame:
    """(node, found: sorted array of shingle hashes) of the wanted nodes; nodes: (node, doc_id) with one document that has the text; once: no two documents have one id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for b in batches:
            out: dict[int, np.ndarray] = {}
            words = Words(list(b["text"]), memo)
            for w in map(words.of, range(len(b))):
                if len(w) and (k := _node(w, seed)[0]) not in out:
                    out[k] = shingles(w, n).view(np.int64)
            yield pd.DataFrame({"node": list(out), "found": list(out.values())})

    ids = nodes.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("__id")).distinct()
    if nodes.count() <= SENT:
        ids = F.broadcast(ids)  # so only the wanted texts leave their partition
    texts = docs.join(ids, F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("__id"), "left_semi").select("text")
    found = texts.mapInPandas(run, "node long, found array<long>")
    return found if once else found.dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Of pairs (a, b), written rows, those whose whole sets meet the threshold. Many b may have one a."""
    own = sets.select(F.col("node").alias("b"), F.col("found").alias("__y")).join(_sent(pairs), "b")
    others = sets.select(F.col("node").alias("a"), F.col("found").alias("__x"))
    others = others.join(_sent(materialize(pairs.select("a").distinct())), "a", "left_semi")
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    often = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > 8 * SALTS).select("a", F.lit(SALTS).alias("copies")))
    others = others.join(_sent(often), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    own = own.join(_sent(often), "a", "left").withColumn("salt", F.when(F.col("copies").isNotNull(), salt).otherwise(0)).drop("copies")
    both = F.size(F.array_intersect("__x", "__y"))
    linked = both * q >= (F.size("__x") + F.size("__y") - both) * p
    return own.join(others, ["a", "salt"]).filter(linked).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over edges (a, b), written rows.

    In a round each node goes to the root that smallest neighbours lead to. Edges then join roots, those within one go: every round has fewer, and none is looked at again.
    """
    files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // EDGES))
    ways = []
    edges = materialize(_apart_ends(edges), files=files)
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), files=files)
        while True:
            step = materialize(_led(up.withColumn("old", F.col("comp")), up, "comp"), files=files)
            up = step.drop("old")
            if not step.filter("old <> comp").limit(1).count():
                break
        ways.append(up)
        edges = materialize(_apart_ends(_led(_led(edges, up, "a"), up, "b")), files=files)
    label = nodes.select("node").withColumn("comp", F.col("node"))
    return _led(label, reduce(lambda later, up: materialize(_led(up, later, "comp"), files=files), reversed(ways)), "comp") if ways else label


def _merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): label, of whose components those of edges (a, b) are one; both are written rows."""
    over = materialize(_led(_led(edges.select("a", "b"), label, "a"), label, "b"))
    comps = over.select(F.col("a").alias("node")).union(over.select("b")).distinct()
    return _led(label, materialize(components(comps, over)), "comp")


def _apart_ends(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _led(rows: DataFrame, label: DataFrame, key: str) -> DataFrame:
    """rows with the component of the node in `key` instead, where label, written rows (node, comp), has one. Most rows may hold one node."""
    to = label.select(F.col("node").alias(key), F.col("comp").alias("__to"))
    to = F.broadcast(to) if label.count() <= SENT else to
    return rows.join(to, key, "left").select(*[F.coalesce("__to", c).alias(c) if c == key else c for c in rows.columns])


def _close(sketches: list[bytes], size: np.ndarray, comp: np.ndarray, left: np.ndarray, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, near): sets with left against those without it; near is false only where size or sketch rules a link out, or the components are one.

    Linked sets' sketches have equal lengths or one twice the other's. Bits that differ are counted by matrix products.
    """
    width = np.array([len(x) for x in sketches])

    def bits(which: np.ndarray, fold: bool) -> np.ndarray:
        x = np.unpackbits(np.frombuffer(b"".join(sketches[i] for i in which), np.uint8).reshape(len(which), -1), axis=1, bitorder="little")
        return (x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :] if fold else x).astype(np.float32)

    for w in np.unique(width).tolist():
        for wa, wb in ((w, w), (w, 2 * w), (2 * w, w)):
            rows, columns = np.flatnonzero(left & (width == wa)), np.flatnonzero(~left & (width == wb))
            if not len(rows) or not len(columns):
                continue
            some = max(1, min(500, CELLS // (4 * w)))
            for to in range(0, len(columns), some):
                b = columns[to : to + some]
                y = bits(b, wb > w)
                for at in range(0, len(rows), some):
                    a = rows[at : at + some]
                    x = bits(a, wa > w)
                    apart = x.sum(1)[:, None] + y.sum(1) - 2 * (x @ y.T)
                    m, n = size[a][:, None], size[b]
                    yield a, b, (apart * (q + p) <= (q - p) * (m + n)) & (np.minimum(m, n) * q >= np.maximum(m, n) * p) & (comp[a][:, None] != comp[b])


def _spanning(sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, p: int, q: int, once: bool = False) -> list[tuple[int, int]]:
    """Pairs (i, j) of linked sets of different components, i with left and j without it, as many as join them. once: each set stands on both sides, so each pair is met twice, and looked at once.

    Sketches rule most pairs out; the others' whole sets are intersected, some at a time, as long as their components are apart.
    """
    sets = [np.sort(x.view(np.uint64)) for x in sets]
    size, label = np.array([len(x) for x in sets], np.int64), comp.copy()
    out = []
    for rows, columns, near in _close([sketch(x, sketch_bits(len(x), p, q)) for x in sets], size, comp, left, p, q):
        if once:
            near &= comp[rows][:, None] < comp[columns]
        for i, hopeful in zip(rows, near, strict=True):
            todo = columns[hopeful]
            while len(todo := todo[label[todo] != label[i]]):
                some = max(1, int(np.searchsorted(np.cumsum(size[todo]), 200_000)))
                now, todo = todo[:some], todo[some:]
                flat = np.concatenate([sets[j] for j in now])
                at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
                inter = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(size[now]) - size[now])
                for j in now[inter * q >= (size[i] + size[now] - inter) * p]:
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        out.append((int(i), int(j)))
    return out


def _blocked(d: DataFrame) -> DataFrame:
    """(unit, i, j, node, comp, left): a unit's nodes dealt to blocks, as many as their sets and shingles ask for; each two blocks i <= j meet, i left. d: (unit, node, comp, size)."""
    many = d.groupBy("unit").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("size") + BLOCK_SHINGLES // BLOCK) / BLOCK_SHINGLES * 2)).cast("long").alias("many"))
    d = d.join(many, "unit").withColumn("own", F.pmod(F.xxhash64("node"), F.col("many")))
    columns = ["unit", "i", "j", "node", "comp", "left"]
    a = d.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("many") - 1))).withColumn("left", F.lit(True))
    b = d.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "own"))).withColumn("left", F.lit(False))
    return a.select(*columns).unionByName(b.select(*columns))


def _hopeful_many(at: DataFrame, info: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b) as _hopeful_few, for signatures of many nodes, block by block: a pair of blocks passes on fewer edges than it has nodes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node, forest = rows["node"].to_numpy(np.int64), _Forest()
        for a, b, near in _close(list(rows["sketch"]), rows["size"].to_numpy(np.int64), rows["comp"].to_numpy(np.int64), rows["left"].to_numpy(bool), p, q):
            _join_near(forest, node[a], node[b], near)
        return forest.frame()

    d = at.join(info.select("node", "size"), "node").select(F.col("sig").alias("unit"), "node", "comp", "size")
    return _blocked(d).join(info, "node").groupBy("unit", "i", "j").applyInPandas(run, "a long, b long")


def _links_in_blocks(cluster: DataFrame, label: DataFrame, info: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): links that join the components of each cluster's nodes as all of its links do; cluster: (node, unit), label: (node, comp). A pair of a cluster's blocks is one task, which holds no more."""
    dealt = materialize(_blocked(cluster.join(label, "node").join(info.select("node", "size"), "node")))
    tasks = max(4 * cluster.sparkSession.sparkContext.defaultParallelism, -(-dealt.count() // BLOCK))
    d = sets.select("node", "found").join(_sent(dealt), "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        node, comp = rows["node"].to_numpy(), rows["comp"].to_numpy(np.int64)
        found = _spanning([np.asarray(x, np.int64) for x in rows["found"]], comp, rows["left"].to_numpy(bool), p, q, once=bool(rows["i"].iloc[0] == rows["j"].iloc[0]))
        return pd.DataFrame([(min(node[i], node[j]), max(node[i], node[j])) for i, j in found], columns=["a", "b"])

    by = ["unit", "i", "j"]  # a stated number of tasks: by bytes alone they would be put together to a few
    return d.repartition(tasks, *by).groupBy(*by).applyInPandas(compare, "a long, b long").distinct()


class _Wanted:
    """The sets of the nodes asked for so far: each text is read and cut once, whichever round wants it."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, seed: int, once: bool):
        self.docs, self.nodes, self.how, self.have, self.sets = docs, nodes, (n, seed, once), None, None

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, found); wanted: (node), distinct."""
        new = wanted if self.have is None else wanted.join(self.have, "node", "left_anti")
        new = materialize(self.nodes.select("node", "doc_id").join(new, "node", "left_semi"))
        if self.have is None or new.limit(1).count():
            sets = materialize(_sets(self.docs, new, *self.how))
            self.have = new.select("node") if self.have is None else self.have.unionByName(new.select("node"))
            self.sets = sets if self.sets is None else self.sets.unionByName(sets)
        return self.sets


def near_groups(docs: DataFrame, shingle: int = 5, p: int = 4, q: int = 5, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, group, node, row) for each row of docs; p / q is the least similarity of a link.

    group tells components apart, node word strings, both null for texts without words; row is a column of docs that names its rows, passed on (null without one).
    """
    with scratch(docs.sparkSession):
        return materialize(_grouped(docs, shingle, p, q, doc_id, text, row), keep=True)


def _grouped(docs: DataFrame, shingle: int, p: int, q: int, doc_id: str, text: str, row: str | None) -> DataFrame:
    spark = docs.sparkSession
    Batches.small(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), (F.col(row) if row else F.lit(None)).cast("string").alias("row"))
    as_text = d.select(F.col("doc_id").cast("string").alias("doc_id"), "row", "text")
    seed = 0
    while True:  # a node is 63 bits of a digest; should two word strings share them, another seed parts them
        members = materialize(_members(as_text, shingle, p, q, seed))
        nodes = members.filter("n_words > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("c"), F.max("check").alias("d"), F.max("n_shingles").alias("size"), F.min("sketch").alias("sketch"))
        nodes = materialize(nodes)
        if not nodes.filter("c <> d").limit(1).count():
            break
        seed += 1
    words = nodes.agg(F.sum("size")).first()[0] or 0
    rows = int(words * 3.5 * (q - p) * 2 / (q + p)) + nodes.count()
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    passes = max(1, math.ceil(3.5 * (q - p) * 2 / (q + p) / A_PASS))
    parts = [materialize(_shared_signatures(d, shingle, p, q, seed, buckets, turn, passes)) for turn in range(passes)]
    shared = reduce(DataFrame.unionByName, parts)
    info = nodes.select("node", "size", "sketch")
    once = not members.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    wanted = _Wanted(d, nodes, shingle, seed, once)
    all_nodes = materialize(shared.select("node").distinct())
    tried = open_ = None
    label = all_nodes.withColumn("comp", F.col("node"))
    at = materialize(_apart(shared.withColumn("comp", F.col("node"))))
    for part in parts:
        discard(part)
    for turn in range(ROUNDS):
        before = at
        near, looked = _stars(at, info, p, q)
        near = materialize(near if tried is None else near.join(tried, ["a", "b"], "left_anti"))
        pairs = materialize(_best(near))
        sets = wanted.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        new = materialize(_verified(pairs, sets, p, q))
        tried = pairs if tried is None else tried.unionByName(pairs)
        linked = bool(new.limit(1).count())
        if linked:
            label = materialize(_merged(label, new) if turn else components(all_nodes, new))
        if turn == 0:  # two nodes of a signature that have nothing else in it are settled if they were looked at, unless they are near and their turn didn't come
            open_ = near.select("a", "b").join(pairs, ["a", "b"], "left_anti")
            two = at.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count_distinct("node").alias("m")).filter("m = 2")
            at = at.join(two.join(looked, ["a", "b"], "left_semi").select("sig"), "sig", "left_anti")
        at = materialize(_apart(at.select("sig", "node").join(_sent(label), "node")))
        discard(before)
        if not linked:
            break
    # signatures that are still apart
    rows = at.select("sig", "node", "comp").distinct()
    sizes = rows.groupBy("sig").agg(F.count("*").alias("m"))
    few = rows.join(sizes.filter(F.col("m") <= FEW).select("sig"), "sig", "left_semi")
    many = materialize(rows.join(sizes.filter(F.col("m") > FEW).select("sig"), "sig", "left_semi"))
    end = lambda x: label.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    open_ = open_.join(end("a"), "a").join(end("b"), "b").filter("ca <> cb").select("a", "b")
    hopeful = materialize(_hopeful_few(few, info, p, q).unionByName(_hopeful_many(many, info, p, q)).unionByName(open_).distinct())
    if hopeful.limit(1).count():
        met = materialize(hopeful.select(F.col("a").alias("node")).union(hopeful.select("b")).distinct())
        cluster = materialize(components(met, hopeful).withColumnRenamed("comp", "unit"))
        more = materialize(_links_in_blocks(cluster, label, info, wanted.of(met), p, q))
        if more.limit(1).count():
            label = _merged(label, more)
    label = nodes.join(label, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = materialize(label.select("node", "comp").join(least, "comp").select("node", "comp", "component_id"))
    out = members.select("doc_id", "row", "n_shingles", F.when(F.col("n_words") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("component_id"), F.col("comp").alias("group"), "node", "row")


def _apart(at: DataFrame) -> DataFrame:
    """at: (sig, node, comp), of the signatures that hold more than one component; lo and hi: (comp, node) of the smallest and the largest one."""
    ends = at.groupBy("sig").agg(F.min(F.struct("comp", "node")).alias("lo"), F.max(F.struct("comp", "node")).alias("hi")).filter("lo.comp <> hi.comp")
    return at.select("sig", "node", "comp").join(ends, "sig")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, p=9, q=10).select("doc_id", "n_shingles", "component_id")
