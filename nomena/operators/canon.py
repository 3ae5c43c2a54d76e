"""Identities: entities that share a key are one; the smallest id stands for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import removed, written


def canon_map(entities: DataFrame, keys: list[Column]) -> DataFrame:
    """(entity_id, canon_id): connected components over equal keys by smallest labels; null keys link nothing.

    Keys that only one entity has link nothing and are left out. Each round goes id -> key -> id with partial sums, so a large group is no hot spot, and then takes the label's
    own label, so the rounds grow with the logarithm of a chain. Each round is written once, and the one before is deleted.
    All joins are merges: Spark takes a written table of labels for as small as its files, far less than its rows in memory, and would send it through the driver in each round.
    """
    every = F.array(*[F.concat(F.lit(f"{i}:"), k) for i, k in enumerate(keys)])
    links = entities.select("entity_id", F.explode(F.array_compact(every)).alias("k"))
    ends = links.groupBy("k").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high")).filter("low < high")
    links = written(links.join(ends.select("k", "low").hint("merge"), "k").select("k", "entity_id", "low"))
    step = written(links.groupBy("entity_id").agg(F.min("low").alias("canon_id")))  # the first round
    labels = step
    held, links = links, links.select("k", "entity_id")
    while True:
        low = links.join(labels.hint("merge"), "entity_id").groupBy("k").agg(F.min("canon_id").alias("low"))
        near = links.join(low.hint("merge"), "k").groupBy("entity_id").agg(F.min("low").alias("low"))
        before, step = step, labels.join(near.hint("merge"), "entity_id").select("entity_id", F.col("canon_id").alias("old"), F.least("canon_id", "low").alias("canon_id"))
        heads = labels.select(F.col("entity_id").alias("canon_id"), F.col("canon_id").alias("further"))
        step = written(step.join(heads.hint("merge"), "canon_id", "left").select("entity_id", "old", F.least("canon_id", F.coalesce("further", "canon_id")).alias("canon_id")))
        removed(before)
        labels = step.select("entity_id", "canon_id")
        if step.filter("old <> canon_id").isEmpty():
            removed(held)
            return entities.select("entity_id").join(labels.hint("merge"), "entity_id", "left").select("entity_id", F.coalesce("canon_id", "entity_id").alias("canon_id"))
