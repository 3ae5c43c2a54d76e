"""Substring deduplication by seed and extend: winnowed anchors, matches extended both ways, maximal repeats over the length threshold.

A repeat is a run of at least LEAST words that also stands in a document with a smaller doc_id. Seeds are runs of SEED words, winnowed: each window of LEAST words chooses its seed with the
smallest hash, so two equal windows choose the same one at the same place. An anchor is a chosen seed with its reach, the words of all windows that chose it (LEAST to 2 * LEAST - SEED of them). Documents are
joined on anchors; a match is extended to the whole reach, or, where reaches differ, window by window to both sides; runs of matching windows that follow one another make maximal repeats.
No pairs of documents are made: an occurrence is only held against the smallest document with the same reach, then windows are only held against the smallest document with the same window. Both are
aggregates, so a group of copies or a passage of any number of documents is one row, whatever its size. Keys are two hashes of 64 bits each.

What is shuffled: seeds (two of seven words begin one) with their document, twice; what follows is about shared seeds only. Of windows only those of reaches at the edge of a repeat are looked at.

Cases: a null or empty text has no words and loses none. A null doc_id comes after all others; rows with equal doc_id, or without one, are no copies of each other (none has the smaller id), and each is judged and
returned. A text repeats nothing of itself. Extra columns pass through unread; an extra column `n_words`, `n_removed`, `repeats` or `kept_text` is replaced by the result's. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, Words, materialize, mix64, run_hashes, scratch, table

LEAST = 13
SEED = 8
LAST = (1 << 63) - 1  # stands for a null doc_id
BASE = 0x9E6C63D0876A9A47


def anchors(words: Words, least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, anchor, reach) of the anchors of a batch: number of the text, first and last window (starts, in words of the batch), hash of the seed, hash of the reach."""
    codes, m = words.codes, len(words.codes) - least + 1
    if m <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    order = mix64(run_hashes(codes, seed))
    best, off = order[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, least - seed + 1):
        less = order[j : j + m] < best
        best[less], off[less] = order[j : j + m][less], j
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    start = np.flatnonzero(text[:m] == text[least - 1 :])
    at = start + off[start]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    first, last, at = start[new], start[np.r_[new[1:], len(start)] - 1] if len(new) else start[new], at[new]
    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(codes), BASE, np.uint64)])
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(codes), pow(BASE, -1, 1 << 64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(codes * up[:-1])]
    reach = (sums[last + least] - sums[first]) * down[first] + ((last - first) * 64 + at - first).astype(np.uint64)
    return text[first], first, last, order[at], mix64(reach)


def _doc(doc_id: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc")


def _seeds(docs: DataFrame, least: int, seed: int, reach: bool) -> DataFrame:
    """(a, doc), or (a, c, doc) with the reach, of every anchor. docs: (doc, text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            text, _, _, a, c = anchors(Words(b.column(1).to_pylist(), memo, lower=False), least, seed)
            cols = {"a": a.view(np.int64), "c": c.view(np.int64), "doc": doc[text].astype(np.int64)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items() if reach or k != "c"})

    return docs.select("doc", F.col("text").cast("binary")).mapInArrow(run, "a long, c long, doc long" if reach else "a long, doc long")


def _windows(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """(a, c, doc, i, w): the windows of the reaches that a document is asked for. docs: (doc, text, c: array<long>)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            doc, asked = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            words = Words(b.column(1).to_pylist(), memo, lower=False)
            text, first, last, a, c = anchors(words, least, seed)
            c = c.view(np.int64)
            hit = np.zeros(len(c), bool)
            edges = np.searchsorted(text, np.arange(len(doc) + 1))
            for t in range(len(doc)):
                s, e = edges[t], edges[t + 1]
                hit[s:e] = np.isin(c[s:e], asked[t].values.to_numpy())
            n = (last - first + 1)[hit]
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = run_hashes(words.codes, least)[np.repeat(first[hit], n) + i] if len(n) else np.zeros(0, np.uint64)
            cols = {"a": np.repeat(a[hit].view(np.int64), n), "c": np.repeat(c[hit], n), "doc": np.repeat(doc[text[hit]], n).astype(np.int64), "i": i.astype(np.int32), "w": mix64(w).view(np.int64)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})

    return docs.select("doc", F.col("text").cast("binary"), "c").mapInArrow(run, "a long, c long, doc long, i int, w long")


def matches(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc, found: array<struct<c, mask, source>>) of the documents that repeat something: per reach, which of its windows also stand in a smaller document, and the smallest such document. docs: (doc, text)

    Written to the shared folder; belongs to the scope around.
    """
    with scratch(docs.sparkSession):
        shared = _seeds(docs, least, seed, False).groupBy("a").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("a")
        shared = materialize(shared)
        held = materialize(_seeds(docs, least, seed, True).join(shared, "a"))
        by = materialize(held.groupBy("a", "c").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
        # reaches of one anchor that differ: the windows of each, in its smallest document
        mixed = by.groupBy("a").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).filter("least < most")
        asked = by.join(mixed.select("a"), "a").groupBy(F.col("lo").alias("doc")).agg(F.collect_set("c").alias("c"))
        w = materialize(_windows(docs.join(asked, "doc"), least, seed))
        w = w.join(w.groupBy("a", "w").agg(F.min("doc").alias("source")), ["a", "w"]).filter("source < doc")
        part = w.groupBy("a", "c", "doc").agg(F.expr("bit_or(shiftleft(1, i))").alias("mask"), F.min("source").alias("source"))
        part = part.withColumnRenamed("doc", "lo")
        every = by.join(part, ["a", "c", "lo"], "left").filter("lo < hi OR mask IS NOT NULL")
        out = held.join(every, ["a", "c"]).select("doc", "c", F.when(F.col("doc") > F.col("lo"), -1).otherwise(F.col("mask")).alias("mask"), F.when(F.col("doc") > F.col("lo"), F.least("lo", "source")).otherwise(F.col("source")).alias("source"))
        return materialize(out.filter("mask IS NOT NULL").distinct().groupBy("doc").agg(F.collect_list(F.struct("c", "mask", "source")).alias("found")), keep=True)


RESULT = "n_words long, n_removed long, repeats array<struct<start:long,end:long,source:long>>, kept_text string"


def _cut(words: Words, found: list, least: int, seed: int) -> Iterator[tuple[int, int, list, str]]:
    """RESULT for each text of a batch, given its matches."""
    text, first, last, _, c = anchors(words, least, seed) if any(f is not None for f in found) else (np.zeros(0, np.int64),) * 5
    c, edges = c.view(np.int64), np.searchsorted(text, np.arange(len(found) + 1))
    for t, f in enumerate(found):
        begin, n = int(words.first[t]), int(words.counts[t])
        own = [words.data[s:e] for s, e in zip(words.starts[begin : begin + n].tolist(), words.ends[begin : begin + n].tolist(), strict=True)]
        runs: list[dict] = []
        if f is not None:
            known = {x["c"]: x for x in f}
            for i in range(edges[t], edges[t + 1]):
                x = known.get(int(c[i]))
                if x is None:
                    continue
                for j in range(int(last[i] - first[i]) + 1):
                    if x["mask"] >> j & 1:
                        start = int(first[i]) + j - begin
                        if runs and runs[-1]["end"] == start + least - 1 and runs[-1]["source"] == x["source"]:
                            runs[-1]["end"] = start + least
                        else:
                            runs.append({"start": start, "end": start + least, "source": x["source"]})
        gone = np.zeros(n, bool)
        for r in runs:
            gone[r["start"] : r["end"]] = True
            r["source"] = None if r["source"] == LAST else int(r["source"])
        kept = own if not runs else [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
        yield n, int(gone.sum()), runs, b" ".join(kept).decode("utf-8", "replace")


def dedup_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, seed: int = SEED) -> DataFrame:
    """docs with n_words, n_removed, repeats (start and end in words, the smallest document that has it; a repeat whose source changes is given in parts) and kept_text, the words left joined by one blank."""
    if not 1 <= seed <= least <= seed + 31:
        raise ValueError("seed must lie between least - 31 and least")
    Batches.small(docs.sparkSession)
    found = matches(docs.select(_doc(doc_id), F.col(text).alias("text")), least, seed).select(F.col("doc").alias("__doc"), F.col("found").alias("__found"))
    memo: dict = {}

    @F.pandas_udf(RESULT)
    def cut(texts: pd.Series, matched: pd.Series) -> pd.DataFrame:
        rows = list(_cut(Words(list(texts), memo, lower=False), list(matched), least, seed))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "repeats", "kept_text"])

    d = docs.withColumn("__key", _doc(doc_id)).join(found, F.col("__key") == F.col("__doc"), "left").withColumn("__cut", cut(F.col(text).cast("binary"), F.col("__found")))
    new = [x.split()[0] for x in RESULT.split(", ")]
    return d.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[F.col(f"__cut.{c}").alias(c) for c in new])


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS t FROM d, range(1, len(ws) - 11) AS x(i)),
f AS (SELECT t, min(coalesce(doc_id, 9223372036854775807)) AS lo FROM w GROUP BY t),
g AS (SELECT DISTINCT r, i + j AS i FROM w JOIN f USING (t), range(0, 13) AS y(j) WHERE lo < coalesce(doc_id, 9223372036854775807)),
l AS (SELECT d.r, d.doc_id, x.i, ws[x.i] AS word, g.i IS NOT NULL AS gone FROM d, range(1, len(ws) + 1) AS x(i) LEFT JOIN g ON g.r = d.r AND g.i = x.i),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM l GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
