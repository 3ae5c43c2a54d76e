"""Candidates kept from one run to the next: a table by content key that only grows by what is missing.

A version is a folder of the store: v=N holds the rows that version N added. Rows of all versions together are the cache; a key is in one version only. A version is written beside and renamed when whole, so a run that dies leaves
the cache as it was, and a reader sees whole versions only. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kb import cache_key

ROWS = "key string, entity_id int, rank int"


class CandidateCache:
    """name: what the candidates depend on besides the mention, such as corpus and method; each has a store of its own."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.at = spark, f"{folder.rstrip('/')}/{name}"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")

    def versions(self) -> list[int]:
        root = self._path("")
        fs = root.getFileSystem(self._conf)
        if not fs.exists(root):
            return []
        return sorted(int(n[2:]) for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("v="))

    def rows(self) -> DataFrame:
        """(key, entity_id, rank) of all versions. A key without candidates has one row, of a null id."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], ROWS)
        try:
            return self.spark.read.schema(ROWS).parquet(*[f"{self.at}/v={v}" for v in found])
        except AnalysisException as e:
            raise RuntimeError(f"the candidate cache at {self.at} can't be read") from e

    def missing(self, mentions: DataFrame) -> DataFrame:
        """(key, surface, year) of mentions that the cache has not, one row a key. mentions: (surface, year, context_left, context_right)."""
        d = mentions.select(cache_key(F.col("surface"), F.col("context_left"), F.col("context_right"), F.col("year")).alias("key"), "surface", "year")
        d = d.groupBy("key").agg(F.min(F.struct("surface", "year")).alias("m")).select("key", "m.surface", "m.year")  # equal by the key
        return d.join(self.rows().select("key").distinct(), "key", "left_anti")

    def fill(self, mentions: DataFrame, candidates: Callable[[DataFrame], DataFrame]) -> int:
        """Works out candidates for what is missing and adds them as a version; the number of new keys. candidates maps distinct (surface, year) to (surface, year, entity_id, rank); where nothing is missing it isn't called."""
        new = self.missing(mentions)
        part = f"_new-{(self.versions() or [0])[-1] + 1}"
        fs = self._path("").getFileSystem(self._conf)
        new.write.mode("overwrite").parquet(f"{self.at}/{part}/keys")
        new = self.spark.read.parquet(f"{self.at}/{part}/keys")
        n = new.count()
        if n:
            found = candidates(new.select("surface", "year").distinct())
            same = F.col("a.surface").eqNullSafe(F.col("b.surface")) & F.col("a.year").eqNullSafe(F.col("b.year"))
            rows = new.alias("a").join(found.alias("b"), same, "left").select("a.key", F.col("b.entity_id").cast("int").alias("entity_id"), F.col("b.rank").cast("int").alias("rank"))
            rows.write.mode("overwrite").parquet(f"{self.at}/{part}/rows")
            if not fs.rename(self._path(f"{part}/rows"), self._path(f"v={part[5:]}")):
                raise RuntimeError(f"version {part[5:]} of the candidate cache exists")
        fs.delete(self._path(part), True)
        return n

    def candidates(self, mentions: DataFrame, most: int | None = None) -> DataFrame:
        """mentions with entity_id and rank, a row for each cached candidate; those without any, or not in the cache, have none."""
        d = mentions.withColumn("__key", cache_key(F.col("surface"), F.col("context_left"), F.col("context_right"), F.col("year")))
        rows = self.rows().filter("entity_id IS NOT NULL").select(F.col("key").alias("__key"), "entity_id", "rank")
        return d.join(rows.filter(F.col("rank") <= most) if most else rows, "__key").drop("__key")
