"""Ordered deduplication, top-k, votes and argmax, each with an explicit order and total ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key; the order must be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_k(df: DataFrame, group: list, order: list, k: int | None, rank: str = "rank") -> DataFrame:
    d = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return d if not k else d.filter(F.col(rank) <= k)


def finalists(df: DataFrame, group: list, lead: Column, order: list, k: int) -> DataFrame:
    """The lead first, then the others in order; at least two."""
    return top_k(df, group, [F.when(lead, 0).otherwise(1), *order], max(2, k))


def majority(df: DataFrame, group: list, pick: str, ties: list) -> DataFrame:
    """One pick a group: most votes, then ties, then the smallest pick."""
    votes = df.groupBy(*group, pick).agg(F.count("*").alias("votes"), *[t.alias(f"__t{i}") for i, t in enumerate(ties)])
    order = [F.desc("votes"), *[F.desc(f"__t{i}") for i in range(len(ties))], F.asc(pick)]
    return top_k(votes, group, order, 1).drop("rank", *[f"__t{i}" for i in range(len(ties))])
