"""Candidate generation for mentions: distinct (surface, year) keys are looked up once, results are ranked by explicit order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, years
from . import grams
from .ranking import keep_first, top_k


def mention_keys(mentions: DataFrame) -> DataFrame:
    """Candidates depend on (surface, year) only: compute them once a key, join back later."""
    return mentions.select("surface", "year").distinct()


def by_title(keys: DataFrame, entities: DataFrame) -> DataFrame:
    """Surface equals title; pos is the entity's place."""
    return keys.join(entities.select(F.col("title").alias("surface"), "entity_id"), "surface").select("surface", "year", "entity_id", F.lit(1).alias("route"), F.col("entity_id").alias("pos"))


def by_alias_year(keys: DataFrame, periods: DataFrame, most: int | None = 30) -> DataFrame:
    """Surface equals a dated name whose period covers the year; first `most` entities. The equi key keeps it a hash join."""
    named = periods.select(F.col("name").alias("surface"), "entity_id", "start_year", "end_year")
    hit = keys.join(named, "surface").filter(years.covers(F.col("start_year"), F.col("end_year"), F.col("year")))
    hit = hit.groupBy("surface", "year", "entity_id").agg(F.lit(0).alias("route"), F.min("entity_id").alias("pos"))
    return top_k(hit, ["surface", "year"], ["pos"], most).drop("rank")


def by_family(keys: DataFrame, entities: DataFrame, most: int = 30) -> DataFrame:
    """The first word of surface and title agree; first `most` entities."""
    first = lambda c: F.substring_index(c, " ", 1)
    base = top_k(entities.select(first("title").alias("base"), "entity_id"), ["base"], ["entity_id"], most).drop("rank")
    return keys.withColumn("base", first("surface")).join(base, "base").select("surface", "year", "entity_id", F.lit(2).alias("route"), F.col("entity_id").alias("pos"))


def by_substring(surfaces: DataFrame, titles: DataFrame, most: int = 30) -> DataFrame:
    """Titles that hold the surface, or lie in it with three characters or more; first `most` by title. surfaces, titles: one column each; a contained text is looked up by its rarest gram."""
    s, t = surfaces.distinct().filter(F.length("surface") >= 2), titles.distinct()
    inside = grams.contained(s.toDF("needle"), t.toDF("hay")).toDF("surface", "title")
    around = grams.contained(t.filter(F.length("title") >= 3).toDF("needle"), s.toDF("hay")).toDF("title", "surface")
    return top_k(inside.unionByName(around).distinct(), ["surface"], ["title"], most)


def union_routes(*routes: DataFrame) -> DataFrame:
    """Routes in order of priority, the first of each entity kept."""
    out = routes[0]
    for r in routes[1:]:
        out = out.unionByName(r)
    return keep_first(out, ["surface", "year", "entity_id"], ["route", "pos"])


def scored(pool: DataFrame, entities: DataFrame, periods: DataFrame) -> DataFrame:
    """The pool with each candidate's year score."""
    ranges = periods.groupBy("entity_id").agg(F.collect_list(F.struct("start_year", "end_year")).alias("ranges"))  # an entity's own periods
    d = pool.join(entities.select("entity_id", "birth_year", "death_year"), "entity_id").join(ranges, "entity_id", "left")
    inside = F.coalesce(F.exists("ranges", lambda p: years.covers(p["start_year"], p["end_year"], F.col("year"))), F.lit(False))
    score = years.year_score(F.col("year"), inside, F.col("birth_year"), F.col("death_year"), F.col("ranges").isNotNull())
    return d.withColumn("score", score.cast("int")).drop("ranges", "birth_year", "death_year")


def gather(keys: DataFrame, entities: DataFrame, periods: DataFrame, k: int | None = None) -> DataFrame:
    """Alias at year, then title, deduplicated and re-ranked by year score; ties keep their order."""
    pool = scored(union_routes(by_alias_year(keys, periods, None), by_title(keys, entities)), entities, periods)
    return top_k(pool, ["surface", "year"], [F.desc("score"), "route", "pos"], k)


#: Queries and vectors of one matrix product: 4 MB of scores.
TILE = 512, 1024


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 16_384) -> DataFrame:
    """(query_id, vec_id, score, rank) by dot product, rounded to five places; a vector is no neighbour of itself.

    The queries are a stated set. They go in blocks of at most about `block`, one pass over the vectors each: a batch of vectors meets them in tiles of bounded size, and a partition keeps the best k of each query, so what is shuffled does not grow with the vectors.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    sc = queries.sparkSession.sparkContext
    best = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        rows = part.select("vec_id", "embedding").toPandas()  # about `block` rows
        sent = sc.broadcast((rows["vec_id"].to_numpy(np.int64), np.stack(rows["embedding"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, 1))))
        found = vectors.select("vec_id", "embedding").mapInPandas(_nearest(sent, k), "query_id long, vec_id long, score double")
        best = found if best is None else best.unionByName(found)
    return top_k(best, ["query_id"], [F.desc("score"), "vec_id"], k)


def _nearest(sent, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        score, vec = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for b in batches:
            for c in range(0, len(b) if len(ids) else 0, TILE[1]):
                part = b.iloc[c : c + TILE[1]]
                at, v = part["vec_id"].to_numpy(np.int64), np.stack(part["embedding"].to_list()).astype(np.float64).T
                for r in range(0, len(ids), TILE[0]):
                    rows = slice(r, r + TILE[0])
                    s = np.round(q[rows] @ v, 5) + 0.0
                    s[ids[rows, None] == at] = -np.inf
                    score[rows], vec[rows] = _best_of(np.hstack([score[rows], s]), np.hstack([vec[rows], np.broadcast_to(at, s.shape)]), k)
        keep = np.isfinite(score)
        yield pd.DataFrame({"query_id": np.repeat(ids, keep.sum(1)), "vec_id": vec[keep], "score": score[keep]})

    return run


def _best_of(score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score))[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)


def within_edits(d: DataFrame, text: str, k: int) -> DataFrame:
    """(a, b, distance), a < b: all pairs of distinct texts within k edits.

    Of k + 1 pieces of the shorter text (the smaller one at equal lengths) one stands whole in the other, moved by k places at most: pairs meet on (length, piece number, piece), a few hundred rows for a text whatever the
    number of texts, and are then measured. Texts shorter than k + 1 have empty pieces and meet all of about their length.
    """
    n, pieces = F.length(text), k + 1
    size = lambda length, i: F.floor((length + i) / pieces).cast("int")
    begin = lambda length, i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0), lambda s, j: s + F.when(j < i, size(length, j)).otherwise(0))
    own = d.select(F.col(text).alias("s"), n.alias("len"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    own = own.select("s", "len", "i", F.expr("s").substr(begin(F.col("len"), F.col("i")) + 1, size(F.col("len"), F.col("i"))).alias("piece"))
    other = d.select(F.col(text).alias("t"), n.alias("n"), F.explode(F.sequence(F.greatest(F.lit(0), n - k), n)).alias("len")).select("t", "n", "len", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    other = other.withColumn("at", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn("from", begin(F.col("len"), F.col("i")) + F.col("at")).filter((F.col("from") >= 0) & (F.col("from") + size(F.col("len"), F.col("i")) <= F.col("n")))
    other = other.select("t", "len", "i", F.col("t").substr(F.col("from") + 1, size(F.col("len"), F.col("i"))).alias("piece"))
    pairs = own.join(other, ["len", "i", "piece"]).filter((F.length("s") < F.length("t")) | ((F.length("s") == F.length("t")) & (F.col("s") < F.col("t")))).select("s", "t").distinct()
    return pairs.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), F.levenshtein("s", "t").alias("distance")).filter(F.col("distance") <= k)


def containing(docs: DataFrame, items: DataFrame, run: int = 3, sent: int = 200_000) -> DataFrame:
    """(doc_id, item_id) where a document's text holds the item verbatim. docs: (doc_id, text), items: (item_id, item).

    An item's words but the first and the last are whole words of such a document, so the two meet on its second to fourth word; only those pairs are searched. Items of fewer words meet on their longest part between blanks.
    The items' keys are broadcast while they are few, else joined by the key.
    """
    words = lambda c: F.split(c, " ", -1)
    key = items.withColumn("w", words("item")).withColumn("key", F.when(F.size("w") >= run + 2, F.array_join(F.slice("w", 2, run), " ")))
    long, short = key.filter("key IS NOT NULL").select("item_id", "item", "key"), key.filter("key IS NULL AND item IS NOT NULL").select("item_id", "item")
    few = F.broadcast if long.count() <= sent else (lambda x: x)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - run, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, F.lit(run)), " ")))
    d = docs.withColumn("w", words("text")).select("doc_id", "text", F.explode(runs).alias("key"))
    out = d.join(few(long), "key").filter(F.col("text").contains(F.col("item"))).select("doc_id", "item_id").distinct()
    if not short.limit(1).count():
        return out
    if short.count() > 1000:
        raise ValueError("more than 1000 items of fewer than five words")
    return out.unionByName(docs.join(F.broadcast(short), F.col("text").contains(F.col("item"))).select("doc_id", "item_id"))


def prior(mentions: DataFrame) -> DataFrame:
    """(surface, entity_id, n, p): how often a surface, in the form of text.surface_key, means an entity."""
    n = mentions.groupBy(text.surface_key("surface").alias("surface"), F.col("gold_id").alias("entity_id")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("surface"))
    return n.withColumn("p", F.round(F.col("n") / total, 9))
