"""Datasets: mentions with their splits and a knowledge base, on disk in one of two layouts, and what is done to them as a whole.

Mentions: sample_idx (place in the file), split, mention, context_left, context_right, label_id, qid, label_title, type and the fields of `metadata`. A label that is no number is a qid.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.kb import PERIODS
from ..operators.ranking import keep_first
from .readers import read_jsonl
from .sinks import write_jsonl

SPLITS = ("train", "valid", "test")
METADATA = "year int, book_name string, start int, end int, tags array<string>, origin_split string, heldout boolean, date string, dataset string, doc_id string, language string, fine_type string, qid string, cluster_id string, sentence string"
RECORD = (
    "numeric_id int, idx string, title string, entity string, text string, metadata struct<category:string,daime:string,reading:string,birth_year:int,death_year:int,language:string,cluster_id:int,cluster_head_eid:string,"
    f"query_name:string,detail_id:string,qid:string,nil:boolean,dataset:string,wd_type:string,span:string,aliases:array<string>,kaimeihyou:{PERIODS}>"
)
#: Files of a knowledge base, the richest first.
ENTITY_FILES = ("entities_evidence.jsonl", "entities_aliased.jsonl", "entities.jsonl")


def _struct(fields: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (f.strip().split(" ", 1) for f in fields.split(", ")))


ROW = f"mention string, context_left string, context_right string, label_id string, label_title string, type string, metadata struct<{_struct(METADATA)}>"


class _Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.at = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.at.getFileSystem(conf)

    def names(self, folders: bool) -> list[str]:
        if not self.is_folder():
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at) if x.isDirectory() == folders)

    def is_folder(self) -> bool:
        return self.fs.exists(self.at) and self.fs.getFileStatus(self.at).isDirectory()


def entity_file(spark: SparkSession, path: str) -> str | None:
    """The richest knowledge-base file of a folder."""
    have = _Folder(spark, path).names(False)
    return next((f"{path.rstrip('/')}/{f}" for f in ENTITY_FILES if f in have), None)


def layout(spark: SparkSession, path: str) -> str:
    """flat: split files in the folder; languages: folders by language with split files; else unknown."""
    top = _Folder(spark, path)
    if any(f"{s}.jsonl" in top.names(False) for s in SPLITS):
        return "flat"
    if any(f.endswith(".jsonl") for sub in top.names(True) for f in _Folder(spark, f"{path}/{sub}").names(False)):
        return "languages"
    return "unknown"


def resolve(spark: SparkSession, name: str, root: str = "data", registry: dict[str, str] | None = None) -> str:
    """The folder of a named dataset: as registered, else dataset_<name>, else dataset/<name> under root, else the name itself as a path."""
    listed = (registry or {}).get(name)
    for at in (listed, f"{root}/dataset_{name}", f"{root}/dataset/{name}", name):
        if at and _Folder(spark, at).is_folder():
            return at
    return listed or name


def available(spark: SparkSession, root: str = "data", registry: dict[str, str] | None = None) -> dict[str, str]:
    """Datasets that can be loaded, with their layout."""
    places = dict(registry or {}) | {x.removeprefix("dataset_"): f"{root}/{x}" for x in _Folder(spark, root).names(True) if x.startswith("dataset_")} | {x: f"{root}/dataset/{x}" for x in _Folder(spark, f"{root}/dataset").names(True)}
    found = {n: layout(spark, p) for n, p in sorted(places.items())}
    return {n: k for n, k in found.items() if k != "unknown"}


def read_mentions(spark: SparkSession, path: str, split: str) -> DataFrame:
    d = read_jsonl(spark, path, ROW)
    named = [c for c in d.schema["metadata"].dataType.fieldNames() if c != "qid"]
    qid = F.coalesce(F.when(F.col("label_id").try_cast("int").isNull(), F.nullif("label_id", F.lit(""))), F.col("metadata.qid"))
    return d.select("sample_idx", F.lit(split).alias("split"), "mention", "context_left", "context_right", F.col("label_id").try_cast("int").alias("label_id"), qid.alias("qid"), "label_title", "type", *[F.col(f"metadata.{c}").alias(c) for c in named])


def read_entities(spark: SparkSession, path: str | None) -> DataFrame:
    """Entities in the columns that the candidate routes and the evidence read; pos is the place in the file. No path: no rows."""
    d = read_jsonl(spark, path, RECORD) if path else spark.createDataFrame([], f"sample_idx long, {RECORD}")
    m = lambda c: F.col(f"metadata.{c}")
    rest = ("category", "daime", "reading", "birth_year", "death_year", "language", "cluster_id", "query_name", "detail_id", "qid", "nil", "dataset", "wd_type", "span", "aliases")
    return d.select(F.col("numeric_id").alias("entity_id"), F.col("sample_idx").alias("pos"), "idx", "title", F.coalesce(F.nullif("text", F.lit("")), "entity").alias("text"), *[m(c).alias(c) for c in rest], m("kaimeihyou").alias("periods"))


@dataclass(frozen=True)
class Dataset:
    mentions: DataFrame
    entities: DataFrame
    name: str = "?"
    layout: str = "flat"
    path: str = ""
    languages: tuple[str, ...] = field(default=())

    @classmethod
    def from_dir(cls, spark: SparkSession, path: str, name: str = "?") -> Dataset:
        """Split files that are missing have no rows."""
        parts = [read_mentions(spark, f"{path}/{s}.jsonl", s) for s in SPLITS]
        return cls(reduce(DataFrame.unionByName, parts), read_entities(spark, entity_file(spark, path)), name, "flat", path)

    @classmethod
    def from_languages(cls, spark: SparkSession, path: str, lang: str | None = None, split: str = "test", name: str = "?") -> Dataset:
        """One language, or all of them; their rows are the test split and keep their language."""
        langs = language_folders(spark, path)
        wanted = langs if lang in (None, "all") else [lang]
        parts = [read_mentions(spark, f"{path}/{x}/{split}.jsonl", "test").withColumn("lang", F.lit(x)) for x in wanted]
        none = read_mentions(spark, f"{path}/{split}.jsonl", "test").withColumn("lang", F.lit(None).cast("string")).limit(0)
        return cls(reduce(DataFrame.unionByName, parts, none), read_entities(spark, None), name, "languages", path, tuple(wanted))

    @classmethod
    def load(cls, spark: SparkSession, name: str, lang: str | None = None, split: str = "test", window: int | None = None, root: str = "data", registry: dict[str, str] | None = None) -> Dataset:
        """A dataset by name or path, whatever its layout; another layout is an error."""
        path = resolve(spark, name, root, registry)
        kind = layout(spark, path)
        if kind == "unknown":
            raise ValueError(f"{name!r}: no dataset at {path}")
        d = cls.from_dir(spark, path, name) if kind == "flat" else cls.from_languages(spark, path, lang, split, name)
        return d.window(window) if window else d

    def filter(self, condition: Column) -> Dataset:
        return replace(self, mentions=self.mentions.filter(condition))

    def tagged(self, tag: str) -> Dataset:
        """The rows that carry the tag; splits and entities stay."""
        return replace(self, mentions=tagged(self.mentions, tag), name=f"{self.name}:{tag}")

    def tags(self) -> DataFrame:
        return tag_counts(self.mentions)

    def window(self, n: int) -> Dataset:
        left, right = text.window_context(F.col("context_left"), F.col("context_right"), n)
        return replace(self, mentions=self.mentions.withColumns({"context_left": left, "context_right": right}), name=f"{self.name}:w{n}")

    def clean(self, drop_no_gold: bool = True, dedup: bool = True, lower_type: bool = False) -> Dataset:
        return replace(self, mentions=cleaned(self.mentions, drop_no_gold, dedup, lower_type))

    def splits(self) -> DataFrame:
        """(split, n), in the order train, valid, test."""
        return self.mentions.groupBy("split").agg(F.count("*").alias("n")).orderBy(F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split")))

    def split(self, name: str) -> DataFrame:
        return self.mentions if name == "all" else self.mentions.filter(F.col("split") == name)

    def langs(self) -> list[str]:
        return list(self.languages)

    def save(self, path: str, splits: tuple[str, ...] = SPLITS, entities: bool = True) -> None:
        """Splits that have rows, and the entities, as folders of JSON lines in row order. What exists is never overwritten."""
        have = {r["split"] for r in self.mentions.select("split").distinct().collect()}
        for s in splits:
            if s in have:
                write_jsonl(self.mentions.filter(F.col("split") == s), f"{path}/{s}.jsonl")
        if entities:
            write_jsonl(self.entities, f"{path}/entities.jsonl", "pos")


def language_folders(spark: SparkSession, path: str) -> list[str]:
    return [x for x in _Folder(spark, path).names(True) if any(f.endswith(".jsonl") for f in _Folder(spark, f"{path}/{x}").names(False))]


def tagged(mentions: DataFrame, tag: str) -> DataFrame:
    return mentions.filter(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), tag))


def tag_counts(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def cleaned(mentions: DataFrame, drop_no_gold: bool = True, dedup: bool = True, lower_type: bool = False) -> DataFrame:
    """Rows without gold go (a missing label, an empty one, -1); of rows of one split with equal mention, label and last 80 characters of left context the first stays; types in lower case."""
    d = mentions
    if drop_no_gold:
        d = d.filter((F.col("label_id").isNotNull() & (F.col("label_id") != -1)) | (F.col("label_id").isNull() & (F.coalesce("qid", F.lit("")) != "")))
    if lower_type:
        d = d.withColumn("type", F.lower("type"))
    if dedup:
        e = lambda c: F.coalesce(F.col(c), F.lit(""))
        d = keep_first(d.withColumn("__left", F.right(e("context_left"), F.lit(80))).withColumn("__m", e("mention")), ["split", "__m", "label_id", "qid", "__left"], ["sample_idx"]).drop("__left", "__m")
    return d


def by_origin(mentions: DataFrame) -> DataFrame:
    """Rows go to the split that they came from; those of another origin go."""
    return mentions.filter(F.col("origin_split").isin(*SPLITS)).withColumn("split", F.col("origin_split"))


def row_slice(mentions: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from start on, limit of them; without a limit all rows, whatever the start."""
    return mentions.filter(F.col("sample_idx").between(start, start + limit - 1)) if limit else mentions
