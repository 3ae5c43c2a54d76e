"""Constrained generation: a prefix tree of the allowed names as a table, and beam search over it as joins.

A node is the text of its path, tokens joined by SEP, the root is ''. Each round joins the live beams of all queries with the children of their nodes, scores these and keeps the best few of each query, finished ones among them:
a query's work is bounded by beams * (children of a node), and rows that a round carries by queries * beams. All queries begin at the root: a node where more than SPLIT beams stand is dealt to parts by the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k
from .storage import removed, written

SEP, END = "\u0001", ""
BEAMS = 5
#: Beams at one node in one part.
SPLIT = 10_000


def children(names: DataFrame) -> DataFrame:
    """(node, token, child): the tree of all names. names: (tokens: array<string>). The token END leads from a name's last node to nothing."""
    n = F.size("tokens")
    path = lambda i: F.array_join(F.slice("tokens", 1, i), SEP)
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(path(i - 1).alias("node"), F.get("tokens", i - 1).alias("token"), path(i).alias("child")))
    last = F.array(F.struct(path(n).alias("node"), F.lit(END).alias("token"), path(n).alias("child")))
    return names.distinct().filter(n > 0).select(F.explode(F.concat(steps, last)).alias("x")).select("x.*").distinct()


def _met(live: DataFrame, tree: DataFrame) -> DataFrame:
    """live.join(tree, "node"), without a task for all beams of one node. live is a written table."""
    often = live.groupBy("node").agg(F.count("*").alias("f")).filter(F.col("f") > SPLIT).select("node", F.ceil(F.col("f") / SPLIT).cast("long").alias("parts"))
    often = F.broadcast(often)  # at most a row for SPLIT beams
    dealt = live.join(often, "node", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("query"), F.col("parts")), F.lit(0))).drop("parts")
    copies = tree.join(often, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, ["node", "part"])


def beam_search(queries: DataFrame, tree: DataFrame, score: Callable[[Column, Column, Column], Column], beams: int = BEAMS, longest: int = 64) -> DataFrame:
    """(query, name, score, rank): the best names of each query; score is the sum over its tokens and END. queries: (query), distinct.

    score(query, node, token) is a column expression, or a call of a model's UDF; larger is better. In each round only the best `beams` of a query's live and finished hypotheses stay, ties by name, so the result is that of a beam search,
    not of all names. A query ends when all that it keeps is finished, at the latest after `longest` rounds.
    """
    tree = written(tree)
    live = written(queries.select("query", F.lit("").alias("node"), F.lit(0).cast("long").alias("score"), F.lit(False).alias("done")))
    for _ in range(longest):
        grown = _met(live.filter("NOT done"), tree)
        grown = grown.select("query", F.col("child").alias("node"), (F.col("score") + score(F.col("query"), F.col("node"), F.col("token"))).cast("long").alias("score"), (F.col("token") == END).alias("done"))
        kept = written(top_k(grown.unionByName(live.filter("done")), ["query"], [F.desc("score"), "node", "done"], beams).drop("rank"))
        removed(live)
        live = kept
        if live.filter("NOT done").isEmpty():
            break
    return top_k(live.filter("done"), ["query"], [F.desc("score"), "node"], beams).select("query", F.replace("node", F.lit(SEP), F.lit("")).alias("name"), "score", "rank")
