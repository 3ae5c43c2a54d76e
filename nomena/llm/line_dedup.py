"""Incremental, reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased; keys of at least 10 code points count. The store holds
three written tables: refs, a row per (key, document) with the lines of it; counts, a row per key with its number of
documents and the smallest one; filters, a cuckoo filter per shard of the keys. A batch asks the filters first: keys that
they rule out are new and need no look at the counts. Deleting documents takes their refs off the counts and keys
without documents off the filters, so a later dedup() is as if they had never come.

Cases: a null or empty text is one empty line. A null doc_id counts as one document, after all others. Rows with equal doc_id are one document in
the counts and each get an output row. Extra columns pass through dedup() unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, materialize, table

LEAST = 10
STRIP = " \t\n\x0b\x0c\r"
#: Keys in a shard of the filters, about; a shard is what one task holds.
SHARD_KEYS = 200_000
LAST = (1 << 63) - 1  # stands for a null doc_id


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. A key's second bucket is its first xor a hash of the fingerprint, so it can move without the key.

    insert() counts equal fingerprints once for each key, delete() takes one off. No false negatives; false positives at about
    8 / 65536. If a key finds no place after MOVES moves, its fingerprint goes to a small overflow list, which is exact.
    """

    SLOTS, MOVES = 4, 200

    def __init__(self, keys: int = 0, data: bytes | None = None):
        if data is None:
            n = 1
            while n * self.SLOTS * 0.9 < keys:
                n *= 2
            self.table, self.over = np.zeros((n, self.SLOTS), np.uint16), []
        else:
            n, m = np.frombuffer(data[:16], np.int64)
            self.table = np.frombuffer(data[16 : 16 + 8 * n], np.uint16).reshape(n, self.SLOTS).copy()
            self.over = np.frombuffer(data[16 + 8 * n :], np.int64).tolist()
            assert len(self.over) == m

    def dump(self) -> bytes:
        return np.array([len(self.table), len(self.over)], np.int64).tobytes() + self.table.tobytes() + np.array(self.over, np.int64).tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64)
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(32)
        print_ = (k & np.uint64(0xFFFF)).astype(np.int64)
        print_[print_ == 0] = 1
        mask = len(self.table) - 1
        first = ((k >> np.uint64(16)) & np.uint64(mask)).astype(np.int64)
        return print_, first, first ^ self._jump(print_)

    def _jump(self, print_):
        return (print_ * 0x5BD1E995) & (len(self.table) - 1)

    def _settle(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts fingerprints into the free slots of their buckets; which of them found none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
        nth = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)]))
        used = (self.table[b] != 0).sum(1)
        fits = used + nth < self.SLOTS
        self.table[b[fits], (used + nth)[fits]] = prints[order][fits]
        return np.sort(order[~fits])

    def insert(self, keys: np.ndarray) -> None:
        """In bulk into the first buckets, then into the second ones; the few keys left move others one by one."""
        prints, one, two = self._places(keys)
        left = self._settle(prints, one)
        left = left[self._settle(prints[left], two[left])]
        for f, at in zip(prints[left].tolist(), two[left].tolist(), strict=True):
            for move in range(self.MOVES):
                row = self.table[at]
                if (row == 0).any():
                    row[int((row != 0).sum())] = f
                    break
                victim = (f + move) % self.SLOTS
                f, row[victim] = int(row[victim]), f
                at ^= int(self._jump(f))
            else:
                self.over.append(int(self._spilled(f, at, at ^ int(self._jump(f)))))

    def _spilled(self, f, one, two):
        return f * len(self.table) + np.minimum(one, two)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, one, two = self._places(keys)
        hit = (self.table[one] == f[:, None]).any(1) | (self.table[two] == f[:, None]).any(1)
        return hit | np.isin(self._spilled(f, one, two), self.over) if self.over else hit

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        f, one, two = self._places(keys)
        for x, a, b in zip(f.tolist(), one.tolist(), two.tolist(), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == x)
                if len(found):
                    row = self.table[at]
                    full = int((row != 0).sum())
                    row[found[0]], row[full - 1] = row[full - 1], 0
                    break
            else:
                self.over.remove(x * len(self.table) + min(a, b))


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc, key) of every line that counts; key: the MD5 digest as two numbers, k1 and k2."""
    spaces = r"\x20\x09-\x0D"
    line = F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), line.alias("line"))
    d = d.withColumn("key", F.translate(F.regexp_replace("line", rf"^[{spaces}]+|[{spaces}]+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    digest = F.md5(F.col("key").cast("binary"))
    half = lambda at: F.expr(f"CAST(conv(substring(digest, {at}, 15), 16, 10) AS BIGINT)")
    d = d.filter(F.length("key") >= LEAST).select("doc", digest.alias("digest"))
    return d.select("doc", half(1).alias("k1"), half(17).alias("k2"))


class LineStore:
    """What is known of the documents so far. insert() and delete() return a new store; earlier ones stay valid."""

    def __init__(self, spark: SparkSession, shard_keys: int = SHARD_KEYS):
        self.spark, self.shard_keys = spark, shard_keys
        self.refs: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = self.built = 0

    def _next(self, refs: DataFrame, counts: DataFrame, filters: DataFrame | None = None) -> LineStore:
        """With new filters over all counts where none are given."""
        new = LineStore(self.spark, self.shard_keys)
        new.refs, new.counts, new.filters, new.shards, new.built = refs, counts, filters, self.shards, self.built
        if filters is None:
            new.built = counts.count()
            new.shards = max(1, -(-new.built // self.shard_keys))
            new.filters = self._filtered(counts, None, new.shards)
        return new

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineStore:
        """Adds documents whose ids are not in the store."""
        batch = materialize(_lines(docs, text, doc_id).distinct())
        keys = materialize(batch.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first_doc")))
        if self.counts is None:
            return self._next(batch, keys)
        seen = self._asked(keys)
        known = seen.filter("maybe").join(self.counts.withColumnsRenamed({"n_docs": "n_old", "first_doc": "first_old"}), ["k1", "k2"], "left")
        fresh = seen.filter("NOT maybe").unionByName(known.filter("n_old IS NULL").drop("n_old", "first_old")).drop("maybe")
        touched = known.filter("n_old IS NOT NULL")
        merged = touched.select("k1", "k2", (F.col("n_docs") + F.col("n_old")).alias("n_docs"), F.least("first_doc", "first_old").alias("first_doc"))
        counts = materialize(self.counts.join(touched.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(merged).unionByName(fresh))
        refs = self.refs.unionByName(batch)
        if counts.count() > 2.5 * self.built:  # the filters were made for three times as many keys as they began with
            return self._next(refs, counts)
        return self._next(refs, counts, self._filtered(fresh, self.filters, self.shards))

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Takes documents off; doc_ids has one column, doc_id. Ids that the store has not are ignored."""
        ids = doc_ids.select(F.coalesce(F.col(doc_ids.columns[0]).cast("long"), F.lit(LAST)).alias("doc")).distinct()
        refs = materialize(self.refs.join(ids, "doc", "left_anti"))
        hit = self.refs.join(ids, "doc", "left_semi").select("k1", "k2").distinct()
        again = refs.join(hit, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first_doc"))
        counts = materialize(self.counts.join(hit, ["k1", "k2"], "left_anti").unionByName(again))
        gone = hit.join(counts, ["k1", "k2"], "left_anti")
        return self._next(refs, counts, self._filtered(gone, self.filters, self.shards, take=True))

    def _filtered(self, keys: DataFrame, old: DataFrame | None, shards: int, take: bool = False) -> DataFrame:
        """The filters with keys added or taken off; a group is a shard, at most about shard_keys keys when it was built."""
        Batches.small(self.spark, 10_000)
        schema = "shard int, data binary, n_keys long"

        def build(key: tuple, rows: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
            k = rows["k1"].to_numpy(np.int64)
            if before is None or before.empty:
                f, n = CuckooFilter(3 * len(k)), 0
            else:
                f, n = CuckooFilter(data=before["data"].iloc[0]), int(before["n_keys"].iloc[0])
            (f.delete if take else f.insert)(k)
            return pd.DataFrame({"shard": [int(key[0])], "data": [f.dump()], "n_keys": [n + (-len(k) if take else len(k))]})

        keyed = keys.select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), "k1")
        if old is None:
            return materialize(keyed.groupBy("shard").applyInPandas(lambda key, rows: build(key, rows), schema))
        return materialize(keyed.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(lambda key, a, b: build(key, a, b), schema))

    def _asked(self, keys: DataFrame) -> DataFrame:
        """keys with `maybe`: false if the filters rule a key out."""

        def ask(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            k = rows["k1"].to_numpy(np.int64)
            maybe = np.zeros(len(k), bool) if before.empty else CuckooFilter(data=before["data"].iloc[0]).contains(k)
            return rows.drop(columns="shard").assign(maybe=maybe)

        keyed = keys.withColumn("shard", F.pmod("k2", F.lit(self.shards)).cast("int"))
        schema = "k1 long, k2 long, n_docs long, first_doc long, maybe boolean"
        return materialize(keyed.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(ask, schema))

    def dedup(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """docs with n_lines, n_dropped and kept_text: lines whose key has two documents or more stay only in the smallest one.

        docs must be in the store. What comes back to a document is the set of its keys to drop, never more than its own lines.
        """
        Batches.small(self.spark)
        shared = self.counts.filter("n_docs > 1")
        drop = self.refs.join(shared, ["k1", "k2"]).filter("doc <> first_doc").groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("__drop"))
        d = docs.withColumn("__doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))).join(drop.withColumnRenamed("doc", "__d"), F.col("__doc") == F.col("__d"), "left")

        @F.pandas_udf("n_lines long, n_dropped long, kept_text string")
        def rest(texts: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_rest(t, a, b) for t, a, b in zip(texts, k1, k2, strict=True)], columns=["n_lines", "n_dropped", "kept_text"])

        d = d.withColumn("__rest", rest(F.col(text), F.col("__drop.k1"), F.col("__drop.k2")))
        return d.select(*docs.columns, "__rest.*")


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line: str) -> str:
    return line.strip(STRIP).translate(_LOWER)


def _rest(text: str | None, k1, k2) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if k1 is None or not len(k1):
        return len(lines), 0, text or ""
    gone = set(zip(map(int, k1), map(int, k2), strict=True))
    kept = []
    for line in lines:
        key = key_of(line)
        if len(key) >= LEAST:
            h = hashlib.md5(key.encode()).hexdigest()
            if (int(h[:15], 16), int(h[16:31], 16)) in gone:
                continue
        kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two batches, even ids and the others, so that the second one asks the filters; the result is that of all together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    store = LineStore(spark).insert(docs.filter(even)).insert(docs.filter(~even))
    d = store.dedup(docs)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM d, range(1, len(ls) + 1) AS t(i)),
s AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT r, l.doc_id, i, line, s.k IS NULL OR l.doc_id = s.first_doc AS stays FROM l LEFT JOIN s ON l.k = s.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY r
"""
