"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the columns of docs.
Cases: nulls in any column, empty and very long texts, ties, repeated rows and extra columns are treated as the operators
say; an empty docs gives an empty result of the same columns. Where one of several rows stays or is repeated, rows are told apart by a number given
once, so equal rows need no key.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomena.llm import decontaminate, mixing, near_dups, quality_rules, sharding
from nomena.llm.common import addressed, leaving, materialize, remove, scratch, table, word_count

#: Near duplicates: shingles of five words, similarity of 4/5 or more.
SHINGLE, P, Q = 5, 4, 5

_LEFT: dict[str, dict[int, list[str]]] = {}


def _stage(place: int):
    """A stage's small tables that its result reads are deleted when a later stage of the session begins on a written result."""

    def wrap(stage):
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            left = _LEFT.setdefault(spark.sparkContext.applicationId, {})
            read = {x.rsplit("/", 2)[-2] for x in docs.inputFiles()} if any(left.get(i) for i in range(place)) else set()
            for before in [i for i in left if i < place]:
                held = left.pop(before)
                if read.isdisjoint(x.rsplit("/", 1)[-1] for x in held):
                    remove(spark, held)
            with leaving(left.setdefault(place, [])):
                return stage(spark, docs, sf_dir)

        return run_stage

    return wrap


@_stage(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.judge(docs, out="__quality").filter("__quality.kept").select(*docs.columns)


@_stage(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document with the smallest doc_id stays; texts without words are in no group."""
    d = addressed(docs)
    with scratch(spark):
        groups = near_dups.near_groups(d.select("doc_id", "text", "__rid"), SHINGLE, P, Q, row="__rid").filter("group IS NOT NULL")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "row")
        first = materialize(groups.groupBy("group").agg(F.count("*").alias("n"), F.min(place).alias("m")).filter("n > 1").select("group", F.col("m.row").alias("stays")))
        few = F.broadcast(first) if first.count() <= near_dups.SENT else first
        go = materialize(groups.join(few, "group").filter("row <> stays").select(F.col("row").alias("__rid")), keep=True)
    return d.join(F.broadcast(go) if go.count() <= near_dups.SENT else go, "__rid", "left_anti").select(*docs.columns)


@_stage(2)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), out="__matches")
    return found.filter(F.size("__matches") == 0).select(*docs.columns)


@_stage(3)
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    d = addressed(docs).withColumn("__words", word_count(F.col("text")))
    key = [F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    taken = mixing.mix(d, F.col("__words"), key, "__rid").filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


@_stage(4)
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard and slot; equal texts are moved together."""
    d = addressed(docs)
    with scratch(spark):
        slim = materialize(d.select("__rid", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("__text")))
        placed = materialize(sharding.shard_rows(slim, F.col("__text"), [F.col("__rid")]).select("__rid", F.col("__shard").alias("shard"), F.col("__slot").alias("slot")), keep=True)
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    return d.select("__rid", *rest).join(placed, "__rid").select(*rest, "shard", "slot")


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("sharding", shards)]

#: The near-duplicate and decontamination stages have no SQL form; tests hold the operators against brute force and the pipeline against invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        with leaving(paths := []):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = materialize(docs)
        written.append(paths)
        if 0 < i < len(STAGES) - 1:  # a stage's output goes when the next one's is written
            remove(spark, written[i - 1])
    return docs
