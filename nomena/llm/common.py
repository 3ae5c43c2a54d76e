"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("nomena_scopes", default=())  # each thread has its own
_LEFT: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), an error on a cluster."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="nomena-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in paths:
        at = jvm.org.apache.hadoop.fs.Path(x)
        at.getFileSystem(conf).delete(at, True)


@atexit.register
def _sweep() -> None:
    """Tables that belong to no scope go with the program: results read them until then. The gateway to the JVM closes later than this runs."""
    if _LEFT and SparkContext._jvm is not None:
        conf = SparkContext._jvm.org.apache.hadoop.conf.Configuration()
        for x in _LEFT:
            at = SparkContext._jvm.org.apache.hadoop.fs.Path(x)
            at.getFileSystem(conf).delete(at, True)


@contextmanager
def leaving(paths: list[str]) -> Iterator[None]:
    """What materialize writes inside is put on the list, for the caller to delete when it has read the result."""
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What materialize writes inside is deleted at the end, but for what it was told to keep: that belongs to the scope around, if there is one."""
    paths: list[str] = []
    try:
        with leaving(paths):
            yield paths
    finally:
        remove(spark, paths)


def materialize(df: DataFrame, keep: bool = False, files: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors, is never recomputed.

    The shuffle files of the write go when it ends, the table with its scope; keep: it goes with the scope around this one. Without a scope, it goes with the program.
    files: at most so many are written. On a local file system each one makes an executor start two processes (chmod), in each of which its memory counts again for a moment.
    """
    df = df.coalesce(files) if files else df
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/nomena-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    at = len(scopes) - 1 - keep
    (scopes[at] if at >= 0 else _LEFT).append(path)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a materialized table before its scope ends."""
    remove(df.sparkSession, [df._at])


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty. Every maximal run of white space turns into one blank first."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(one == "", 0).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("long")


def unit(*parts: Column) -> Column:
    """A reproducible number in (0, 1) from the first 52 bits of an MD5 digest, the same in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of value over the rows of the same group that stand before, in the order of (bucket, order).

    Two levels, so that one large group is never sorted in one task: sums per (group, bucket) are added up over the few
    buckets of a group, then each bucket is summed for itself. `bucket` must follow the order. Groups may be null.
    """
    v = "__value"
    df = df.withColumn(v, value)
    keys = [F.col(g) for g in group]
    sums = df.groupBy(*keys, F.col(bucket)).agg(F.sum(v).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(bucket).alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    on = F.col(bucket).eqNullSafe(F.col("__b"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(starts, on, "left")
    return joined.withColumn(out, F.col("__start") + F.coalesce(F.sum(v).over(inner), F.lit(0))).drop(v, "__start", "__b", *[f"__g{i}" for i in range(len(group))])


class Batches:
    """Holds spark.sql.execution.arrow.maxRecordsPerBatch at `rows`, so that a batch of long texts fits a Python worker."""

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @classmethod
    def small(cls, spark: SparkSession, rows: int = 512) -> None:
        if not 0 < int(spark.conf.get(cls.KEY)) <= rows:
            spark.conf.set(cls.KEY, str(rows))


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, what is written hands Python batches of at most so many rows, each of which holds much."""
    before = spark.conf.get(Batches.KEY)
    spark.conf.set(Batches.KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(Batches.KEY, before)


@contextmanager
def large_rows(spark: SparkSession, rows: int = 16) -> Iterator[None]:
    """Inside, files are read by so many rows at once: by the default of 4096, tables whose rows hold megabytes are decoded by whole files."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts as 64-bit hashes, never 0, computed over the bytes at once; A-Z hash as a-z unless told otherwise.

    Of every byte's random number times a power of an odd base the running sums are taken; a word's polynomial is the difference of
    two of them, brought back by the power at its start. Two such polynomials and the length make a hash. In UTF-8 no byte of a longer
    character is white space or a letter A-Z. Long inputs go in pieces of PIECE bytes, cut between words.
    """

    PIECE = 1 << 20
    BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)

    def __init__(self, texts: list[bytes | str | None], memo: dict | None = None, lower: bool = True):
        """memo: a dictionary that holds the powers from one batch to the next."""
        self.memo, self.lower = {} if memo is None else memo, lower
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"" for t in texts]
        self.data = b"\n".join(raw)
        lengths = np.array([len(t) for t in raw], np.int64)
        offsets = np.cumsum(lengths + 1) - lengths - 1
        buf = np.frombuffer(self.data, np.uint8)
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~space[buf]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, offsets)  # a text's first word
        self.counts = np.diff(np.r_[self.first, len(self.starts)])
        self.codes = self._hashed(buf)

    def _powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        have = self.memo.get((base, self.lower))
        if have is None or len(have[1]) < n:
            grown = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
            numbers = np.random.default_rng(base).integers(0, 1 << 64, 256, np.uint64)
            if self.lower:
                numbers[65:91] = numbers[97:123]
            have = self.memo[base, self.lower] = numbers, grown(pow(base, -1, 1 << 64)), grown(base)
        return have

    def _hashed(self, buf: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(self.starts), np.uint64), 0
        while i < len(out):
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + self.PIECE, side="right")))
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            piece, h = buf[at : at + e[-1]], (e - s).astype(np.uint64)
            for base in self.BASES:
                numbers, down, up = self._powers(base, max(min(self.PIECE, len(buf)), len(piece)))
                sums = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(numbers[piece] * down[: len(piece)], out=sums[1:])
                h = mix64(h + (sums[e] - sums[s]) * up[s])
            out[i:j] = h
            i = j
        out[out == 0] = 1
        return out

    def of(self, i: int) -> np.ndarray:
        """The hashes of text i."""
        return self.codes[self.first[i] : self.first[i] + self.counts[i]]

    def between(self, a: int, z: int) -> str:
        """Words a to z (of the batch) in lower case, joined by blanks."""
        return b" ".join(self.data[self.starts[a] : self.ends[z - 1]].lower().split(None)).decode("utf-8", "replace") if z > a else ""


def run_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words: a polynomial in the words' hashes."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    h = codes[: len(codes) - n + 1].copy()
    for j in range(1, n):
        h *= np.uint64(0xD1342543DE82EF95)
        h += codes[j : j + len(h)]
    return h


def _file_rows(plan) -> bool:
    """Whether each row of an analyzed plan is a row of a file, once at most: files under projections and filters, whose results are the same each time."""
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def addressed(docs: DataFrame, out: str = "__rid") -> DataFrame:
    """docs with an address of each row: rows without a usable key can be joined back to.

    Rows of files are named by the file and their place in it, so nothing is copied; other frames (a join or an explode may repeat a file's row) are
    written once with a number for each row.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.deterministic() and _file_rows(plan):
        try:
            at = docs.metadataColumn("_metadata")
            found = docs.withColumn(out, F.concat_ws(":", F.xxhash64(at["file_path"]), at["file_name"], at["row_index"]))
            found.schema  # noqa: B018
            return found
        except AnalysisException:
            pass
    return materialize(docs.withColumn(out, F.monotonically_increasing_id().cast("string")))
