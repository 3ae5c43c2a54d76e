"""Lexical retrieval: an inverted index with whole-number weights, a search that leaves out what can't count, and rankings held against candidate lists.

The weight of a term in a document is idf * tf', with tf' = 1000 * tf div (tf + 1 + length div mean length) and idf = 1 + floor(log2(documents div documents with the term)), all in whole numbers; a score is the sum over the
query's different terms. Terms are runs between blanks and line ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import top_k
from .storage import batches, written

#: The rarest terms of a query give the first bound: as many as together have so many postings for each result wanted, and one at least.
FIRST = 16
#: Documents of a term in one part of a join.
SPLIT = 50_000


def terms(c: Column | str) -> Column:
    """The terms of a text, in order, repeats included."""
    return F.array_remove(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "[ \\n]+"), "")


def _postings(docs: DataFrame, mean: int) -> DataFrame:
    """(term, doc_id, tf) with tf weighed: a document's terms are counted where it is read, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[w for w in t.replace(b"\n", b" ").split(b" ") if w] for t in b.column(1).to_pylist()]
            length = np.array([len(w) for w in own], np.int64)
            words = pa.array([w for x in own for w in x], pa.binary()).dictionary_encode()
            if not len(words):
                continue
            key, tf = np.unique(np.repeat(np.arange(len(own)), length) * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
            doc, term = key // len(words.dictionary), key % len(words.dictionary)
            yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()).take(pa.array(term)), b.column(0).take(pa.array(doc)), pa.array((1000 * tf // (tf + 1 + length[doc] // mean)).astype(np.int32))], ["term", "doc_id", "tf"])

    return docs.mapInArrow(run, "term string, doc_id long, tf int")


@dataclass(frozen=True)
class LexicalIndex:
    """postings: (term, doc_id, tf), tf' in fact, files ordered by term; lexicon: (term, df, idf, most), the number of documents and the largest weight of each term. Tables of their own."""

    postings: DataFrame
    lexicon: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LexicalIndex:
        """docs: one row a document; null and empty texts have no postings."""
        d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        n, total = d.agg(F.count("*"), F.sum(F.size(terms("text")).cast("long"))).first()
        with batches(docs.sparkSession, 256):
            postings = written(_postings(d.select("doc_id", F.col("text").cast("binary")), max(1, (total or 0) // max(1, n))).sortWithinPartitions("term"))
        lexicon = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("tf"))
        idf = F.length(F.bin(F.expr(f"{n}L div df"))).cast("long")
        return cls(postings, written(lexicon.select("term", "df", idf.alias("idf"), (F.col("tf") * idf).alias("most"))))

    def search(self, queries: DataFrame, k: int, text: str = "text", query_id: str = "query_id") -> DataFrame:
        """(query_id, doc_id, score, rank): exact top k, ties by the smaller doc_id; documents without a term of the query have no row.

        First the postings of each query's rarest terms give a score that k documents reach at least. Terms whose largest weights together stay below it can't bring in a document of their own, so their long postings are never
        joined to the query as a whole: they only add to documents that a rarer term has found and that may still reach the bound.
        """
        q = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(text))).alias("term")).distinct()
        q = top_k(q.join(self.lexicon, "term"), ["query_id"], ["df", "term"], None, "place")  # a query's own terms, rarest first
        before = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        q = written(q.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0))))
        first = self._hits(q.filter(F.col("before") < FIRST * k)).groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))
        bound = top_k(first, ["query_id"], [F.desc("score")], k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("bound"))
        after = Window.partitionBy("query_id").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
        q = q.join(bound, "query_id", "left").withColumn("rest", F.coalesce(F.sum("most").over(after), F.lit(0)))
        own = F.col("rest") + F.col("most") >= F.coalesce("bound", F.lit(0))  # it and all more frequent terms may reach the bound together
        q = written(q.withColumn("leads", own))
        led = written(self._hits(q.filter("leads")).groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score")))
        reached = top_k(led, ["query_id"], [F.desc("score")], k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("reached"))  # a better bound: k documents have this much
        left = q.groupBy("query_id").agg(F.sum(F.when(~F.col("leads"), F.col("most")).otherwise(0)).alias("left")).join(reached, "query_id")
        led = written(led.join(left, "query_id").filter(F.col("score") + F.col("left") >= F.col("reached")).select("query_id", "doc_id", "score"))
        more = led.select("query_id", "doc_id").join(q.filter("NOT leads").select("query_id", "term", "idf"), "query_id").join(self.postings, ["term", "doc_id"]).select("query_id", "doc_id", (F.col("tf") * F.col("idf")).alias("score"))
        return top_k(led.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")), ["query_id"], [F.desc("score"), "doc_id"], k)

    def _hits(self, q: DataFrame) -> DataFrame:
        """Postings of the queries' terms; those of a frequent term are dealt to parts."""
        parts = F.ceil(F.col("df") / SPLIT).cast("long")
        asked = q.select("query_id", "term", "idf", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        used = q.select("term", parts.alias("parts")).distinct()
        found = self.postings.join(used, "term").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        return asked.join(found, ["term", "part"]).select("query_id", "doc_id", (F.col("tf") * F.col("idf")).alias("weight"))


#: Queries of one pass over the texts.
BLOCK = 512


def search_texts(docs: DataFrame, queries: DataFrame, k: int, rarest: int | None = None, text: str = "text", doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank): as LexicalIndex.search, without an index, in two passes over the texts for each BLOCK of queries; rarest: the score is the number of the query's so many rarest terms that a document has.

    The queries are a stated set. A pass holds one block of them; each task scores its own documents and keeps the best k of each query, so neither postings nor scores are shuffled.
    """
    n, total = docs.agg(F.count("*"), F.sum(F.size(terms(text)).cast("long"))).first()
    mean = max(1, (total or 0) // max(1, n))
    d = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(terms(text)).alias("terms"))
    blocks, best = max(1, -(-asked.count() // BLOCK)), None
    with batches(docs.sparkSession, 256):
        for i in range(blocks):
            rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()  # about BLOCK rows
            vocabulary = {t.encode(): j for j, t in enumerate(dict.fromkeys(t for r in rows for t in r["terms"]))}
            df = np.zeros(len(vocabulary), np.int64)
            for r in d.mapInArrow(_counted(vocabulary), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of one block
                df[r["term"]] = r["df"]
            weights = np.zeros((len(vocabulary), len(rows)), np.float64)
            for j, r in enumerate(rows):
                own = [t for t in r["terms"] if df[vocabulary[t.encode()]]]
                for t in sorted(own, key=lambda t: (df[vocabulary[t.encode()]], t.encode()))[:rarest]:
                    v = vocabulary[t.encode()]
                    weights[v, j] = 1 if rarest else int(n // df[v]).bit_length()
            sent = docs.sparkSession.sparkContext.broadcast((vocabulary, weights, np.array([r["query_id"] for r in rows], np.int64)))
            found = written(d.mapInArrow(_scored(sent, k, mean, rarest is not None), "query_id long, doc_id long, score long"))
            best = found if best is None else best.unionByName(found)
    return top_k(best, ["query_id"], [F.desc("score"), "doc_id"], k)


def _known(vocabulary: dict[bytes, int], text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(terms, counts, length) of a text."""
    words = [w for w in text.replace(b"\n", b" ").split(b" ") if w]
    term, tf = np.unique(np.array([v for v in map(vocabulary.get, words) if v is not None], np.int64), return_counts=True)
    return term, tf, len(words)


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for t in b.column(1).to_pylist():
                df[_known(vocabulary, t)[0]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["term", "df"])

    return run


def _scored(sent, k: int, mean: int, counting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, ids = sent.value
        score, doc = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for b in batches:
            s = np.zeros((b.num_rows, len(ids)))
            for i, t in enumerate(b.column(1).to_pylist()):
                term, tf, length = _known(vocabulary, t)
                s[i] = (np.ones(len(tf)) if counting else 1000 * tf // (tf + 1 + length // mean)) @ weights[term]
            at = b.column(0).to_numpy()
            score, doc = np.hstack([score, s.T]), np.hstack([doc, np.broadcast_to(at, (len(ids), len(at)))])
            order = np.lexsort((doc, -score))[:, :k]
            score, doc = np.take_along_axis(score, order, 1), np.take_along_axis(doc, order, 1)
        row, col = np.nonzero(score > 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(doc[row, col]), pa.array(score[row, col].astype(np.int64))], ["query_id", "doc_id", "score"])

    return run


def held_to_lists(run: DataFrame, lists: DataFrame) -> DataFrame:
    """(query_id, doc_id, place): the best of a ranking that is in the query's candidate list, with its place in the ranking; where none is, the list's first, without a place. run: (query_id, doc_id, rank), lists: (query_id, doc_id, place)."""
    both = lists.withColumnRenamed("place", "listed").join(run, ["query_id", "doc_id"], "left")
    best = F.min(F.struct(F.coalesce("rank", F.lit((1 << 31) - 1)).alias("r"), "listed", "doc_id")).alias("b")
    return both.groupBy("query_id").agg(best).select("query_id", "b.doc_id", F.when(F.col("b.r") < (1 << 31) - 1, F.col("b.r")).alias("place"))
