"""Balanced label propagation into shards of equal row counts. DataFrame functions only.

Documents with equal keys (here: equal texts) are linked. Cases: a null text is an empty one, and empty texts are linked like
others; null ids and repeated rows are placed as any row (which of several equal rows gets which slot makes no difference);
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, running, scratch, table

SHARDS = 16
#: A group of more than rows / (shards * PARTS) is dealt out in parts of about that many, so no task holds it; only such groups' counts go to the driver.
PARTS = 16
ROUNDS = 3
#: Rows in a written file, about (some 60 bytes each), where that gives every core one: rounds write many tables, whatever number of partitions a shuffle has.
FILE_ROWS = 50_000


def shard_rows(docs: DataFrame, link: Column, key: list[Column], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """docs with __shard and __slot; counts of the shards are at most one apart, slots run from 0 in each shard.

    Start: a row's shard is its place in a hashed order. Large groups vote first, each as one: the largest goes whole to the shard with most of its
    members among those with room for it; one that fits nowhere whole is split by parts over the freest shards. A round: each other
    group counts its members by shard (a join and a partial sum) and votes for the shard where most of its neighbours are; rows elsewhere ask to move there. Shard s takes
    as many rows as its quota leaves beside the linked rows that stay, the ones with most neighbours first. Unlinked rows cut no edge wherever
    they are, so they fill what is left of the quotas. docs should be a written table.
    """
    with scratch(docs.sparkSession):
        n = docs.count()
        return materialize(_sharded(docs, n, link, key, shards, rounds), keep=True, files=_files(docs, n))


def _files(docs: DataFrame, n: int) -> int:
    """In how many files n rows are written."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // FILE_ROWS))


def _sharded(docs: DataFrame, n: int, link: Column, key: list[Column], shards: int, rounds: int) -> DataFrame:
    if n == 0:
        return docs.withColumns({"__shard": F.lit(0), "__slot": F.lit(0).cast("long")}).limit(0)
    files = _files(docs, n)
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    part = max(8, n // (shards * PARTS))
    buckets = math.isqrt(n // shards) + 1  # as many as rows in each, so neither the sums nor the rows of a bucket get many
    d = docs.withColumn("__link", link).withColumn("__hash", F.xxhash64(*key, F.col("__link")))
    groups = d.groupBy("__link").agg(F.count("*").alias("__n"))
    large = groups.filter(F.col("__n") > part).select(F.col("__link").alias("__l"), F.ceil(F.col("__n") / part).cast("long").alias("__parts"))
    large = materialize(large, files=files)
    d = d.join(F.broadcast(large), F.col("__link") == F.col("__l"), "left").drop("__l")  # fewer than n / part = shards * PARTS rows
    d = d.withColumn("__large", F.when(F.col("__parts").isNotNull(), F.xxhash64("__link")))
    d = d.withColumn("__part", F.xxhash64("__link", F.pmod("__hash", F.coalesce("__parts", F.lit(1))))).drop("__parts", "__link")
    whole = d.groupBy("__part").agg(F.count("*").alias("__n")).filter("__n > 1").withColumnRenamed("__part", "__p")
    d = d.join(whole, F.col("__part") == F.col("__p"), "left").withColumn("__linked", F.col("__p").isNotNull() | F.col("__large").isNotNull()).drop("__p", "__n")
    d = materialize(d.withColumn("__shard", F.pmod("__hash", F.lit(shards)).cast("int")), files=files)
    full = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, quota[s])])
    # at most 2 * shards * PARTS parts, each in at most `shards` shards (in small tables, no more than the rows)
    counts = d.filter("__large IS NOT NULL").groupBy("__large", "__part", "__shard").agg(F.count("*").alias("__n")).collect() if large.count() else []
    homes = _frame(d, _homes([tuple(r) for r in counts], quota))
    for turn in range(rounds):
        linked = d.filter("__linked AND __large IS NULL")
        votes = linked.groupBy("__part", "__shard").agg(F.count("*").alias("__votes"))
        best = votes.groupBy("__part").agg(F.max(F.struct("__votes", F.pmod(F.xxhash64("__part", "__shard"), F.lit(1 << 30)), "__shard")).alias("__b")).select(F.col("__part").alias("__p"), F.col("__b.__shard").alias("__want"), F.col("__b.__votes").alias("__gain"))
        d = d.join(best, F.col("__part") == F.col("__p"), "left").drop("__p")
        # who wants where: large groups first, then rows in place, then by gain; unlinked rows come last and stay where there is room
        d = d.join(F.broadcast(homes), F.col("__part") == F.col("__p"), "left").drop("__p")
        d = d.withColumn("__want", F.coalesce("__home", "__want", "__shard"))
        d = d.withColumn("__class", F.when(F.col("__home").isNotNull(), 0).when(F.col("__linked") & (F.col("__want") == F.col("__shard")), 1).when(F.col("__linked"), 2).otherwise(3))
        d = _place(d, quota, buckets, full, files)
        d = materialize(d.drop("__want", "__gain", "__class", "__home"), files=files)
    d = d.withColumn("__bucket", F.pmod(F.shiftright("__hash", 7), F.lit(buckets)))
    out = running(d, ["__shard"], "__bucket", [F.col("__hash")], F.lit(1), "__slot")
    return out.drop("__hash", "__part", "__large", "__linked", "__bucket")


def _homes(counts: list[tuple[int, int, int, int]], quota: list[int]) -> dict[int, int]:
    """The shard of each part of the large groups. counts: (group, part, shard, rows)."""
    votes: dict[int, list[int]] = {}
    parts: dict[int, dict[int, int]] = {}
    for group, part, shard, n in counts:
        votes.setdefault(group, [0] * len(quota))[shard] += n
        sizes = parts.setdefault(group, {})
        sizes[part] = sizes.get(part, 0) + n
    free, out = list(quota), {}
    for group in sorted(votes, key=lambda g: (-sum(votes[g]), g)):
        size = sum(votes[group])
        fits = [s for s in range(len(quota)) if free[s] >= size]
        at = max(fits or range(len(quota)), key=lambda s: (votes[group][s] if fits else free[s], free[s], -s))
        for part, n in sorted(parts[group].items(), key=lambda x: (-x[1], x[0])):
            if free[at] < n:  # only in a group that fits nowhere whole; what a part has beyond the freest shard's room is placed as other rows are
                at = max(range(len(quota)), key=lambda s: (free[s], -s))
            out[part] = at
            free[at] -= n
    return out


def _frame(d: DataFrame, homes: dict[int, int]) -> DataFrame:
    return d.sparkSession.createDataFrame(list(homes.items()), "__p long, __home int")


def _place(d: DataFrame, quota: list[int], buckets: int, full: Column, files: int) -> DataFrame:
    """Gives each row the wanted shard while its quota lasts, in the order of __class, then -__gain; others fill up what is left."""
    d = d.withColumn("__pace", F.col("__class") * 64 + F.when(F.col("__class") == 2, 40 - F.least(F.lit(40), F.floor(F.log2(F.coalesce("__gain", F.lit(1)) + 0.0)))).otherwise(0))
    d = d.withColumn("__bucket", F.col("__pace") * buckets + F.pmod(F.shiftright("__hash", 7), F.lit(buckets)))
    d = running(d, ["__want"], "__bucket", [F.col("__hash")], F.lit(1), "__at")
    d = materialize(d.withColumn("__shard", F.when(F.col("__at") < full[F.col("__want")], F.col("__want"))).drop("__at", "__pace"), files=files)
    taken = {r[0]: r[1] for r in d.filter("__shard IS NOT NULL").groupBy("__shard").count().collect()}  # a row per shard
    free, cuts = [quota[s] - taken.get(s, 0) for s in range(len(quota))], [0]
    for x in free:
        cuts.append(cuts[-1] + x)
    rest = d.filter("__shard IS NULL").withColumn("__one", F.lit(0)).withColumn("__bucket", F.when(F.col("__linked"), F.pmod("__part", F.lit(buckets * len(quota)))).otherwise(buckets * len(quota) + F.pmod("__hash", F.lit(buckets * len(quota)))))
    rest = running(rest, ["__one"], "__bucket", [F.col("__part"), F.col("__hash")], F.lit(1), "__at")
    where = F.lit(0)
    for s in range(len(quota)):
        where = F.when(F.col("__at") >= cuts[s], s).otherwise(where) if free[s] else where
    rest = rest.withColumn("__shard", where.cast("int"))
    return d.filter("__shard IS NOT NULL").unionByName(rest.drop("__one", "__at")).drop("__bucket")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    d = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("link"))
    with scratch(spark):
        d = materialize(d, files=_files(d, n))
        out = materialize(_sharded(d, n, F.col("link"), [F.col("doc_id"), F.col("size")], SHARDS, ROUNDS), keep=True, files=_files(d, n))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
