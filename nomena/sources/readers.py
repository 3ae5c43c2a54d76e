"""Readers of line formats. Line numbers are positions in the file, found without reading a file in one task: what a line inherits from lines before it (its number, its document) is scanned block by block."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.numbering import carried, running_sum

#: Encodings of annotation files, the first that decodes counts.
ENCODINGS = ("shift-jis", "cp932", "iso-2022-jp", "euc-jp", "utf-8")
ANNOTATION = "file string, mention string, parent_name string, kana string, comment string, category string, start int, end int, context_left string, context_right string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, block, value): blocks of a file are counted, and rows numbered within their block; empty lines count. block: where the row's block of the file begins."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    return running_sum(d, ["file"], "block", "at", F.lit(1), "line_no").select("file", F.col("line_no").cast("long").alias("line_no"), "block", "value")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of one file with sample_idx, their line in it from 0 (an empty line is no row but counts); a missing file has no rows. A line that is no JSON is an error that names it."""
    empty = spark.createDataFrame([], schema)
    try:
        lines = read_lines(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "file string, line_no long, value string")
    broken = F.raise_error(F.concat(F.lit("no JSON in line "), F.col("line_no"), F.lit(" of "), F.col("file"))).cast("string")
    value = F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(broken)
    rows = lines.filter(F.trim("value") != "").select("line_no", F.from_json(value, empty.schema).alias("r"))
    return rows.filter(F.col("r").isNotNull()).select(F.col("line_no").alias("sample_idx"), "r.*")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rank, score) of a run file; lines of fewer than six fields go."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(f.alias("f")).filter(F.size("f") >= 6).select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("docid"), F.col("f")[3].try_cast("int").alias("rank"), F.col("f")[4].try_cast("double").alias("score"))


def read_tokens(spark: SparkSession, path: str, ner: int = 1, nel: int = 7, misc: int = 9) -> DataFrame:
    """(file, document_id, line_no, token, ner, nel, no_space) of token TSV; ner, nel, misc: column positions. A document goes from one document_id line to the next."""
    doc = F.regexp_extract("value", r"^#\s*[\w-]+:document_id\s*=\s*(.*?)\s*$", 1)
    d = carried(read_lines(spark, path), ["file"], "block", "line_no", F.nullif(doc, F.lit("")), "document_id").withColumn("f", F.split("value", "\t"))
    d = d.filter(~F.col("value").startswith("#") & ~F.col("value").startswith("TOKEN\t") & (F.size("f") > max(ner, nel, misc)))
    return d.select("file", "document_id", "line_no", F.col("f")[0].alias("token"), F.col("f")[ner].alias("ner"), F.col("f")[nel].alias("nel"), F.col("f")[misc].contains("NoSpaceAfter").alias("no_space"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, sentence, form, entity_id, type, base_name): each token that opens an entity, with its sentence's text."""
    text = F.regexp_extract("value", r"^# text = (.*)$", 1)
    d = carried(read_lines(spark, path), ["file"], "block", "line_no", F.nullif(text, F.lit("")), "sentence").withColumn("f", F.split("value", "\t"))
    got = lambda pattern, i: F.nullif(F.regexp_extract(F.col("f")[9], pattern, i), F.lit(""))
    opening = r"Entity=\((e\d+)-([^-()|]+)"
    d = d.filter((F.size("f") == 10) & ~F.col("value").startswith("#"))
    return d.select("file", "line_no", "sentence", F.col("f")[1].alias("form"), got(opening, 1).alias("entity_id"), got(opening, 2).alias("type"), got(r"base_name=([^|]+)", 1).alias("base_name")).filter("entity_id IS NOT NULL")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of annotation CSV files in Japanese encodings; values are trimmed, bad numbers are 0, files that no encoding decodes are skipped."""

    def number(x: str | None) -> int:
        try:
            return int((x or "").strip())
        except ValueError:
            return 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                for encoding in ENCODINGS:
                    try:
                        text = content.decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    continue
                out = []
                for r in csv.DictReader(io.StringIO(text, newline="")):
                    v = lambda k, r=r: (r.get(k) or "").strip()
                    out.append((file, v("keyword"), v("parent_keyword") or v("keyword"), v("kana"), v("comment"), v("category"), number(r.get("start")), number(r.get("end")), v("context_left"), v("context_right")))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ANNOTATION.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ANNOTATION)
