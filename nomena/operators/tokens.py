"""Annotated token documents: from files of token rows to documents, and from documents to linked mentions.

Documents are units of bounded size (an article, a page), so one row holds one; a file of any size is read by blocks, whose lines learn their document by a segmented scan. There are two dialects. strict: columns are found by the
header's names; a mention goes on while the label is I- and of its type, and takes the first qid of any of its tokens. loose: fixed columns; a mention opens only at a token with a qid, goes on over any I-
label, and has the first of the qids that the token names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import read_lines
from .numbering import numbered, running_sum

#: What opens a line of document facts, and the columns of the loose dialect.
FACT = "# hipe2022:"
LOOSE = {"TOKEN": 0, "NE-COARSE-LIT": 1, "NE-FINE-LIT": 3, "NEL-LIT": 7, "MISC": 9}
MENTION = "mention string, context_left string, context_right string, qid string, type string, fine_type string, start int, end int, ord int"


def read_documents(spark: SparkSession, path: str, dialect: str = "strict") -> DataFrame:
    """(file, ord, facts: map, tokens: array<struct<tok, ner, nel, fine, no_space>>) of token files; masked files are left out, documents without tokens too."""
    d = read_lines(spark, path).filter(~F.element_at(F.split("file", "/"), -1).contains("masked"))
    headers = d.filter(F.col("value").startswith("TOKEN\t")).groupBy("file").agg(F.split(F.min_by("value", "line_no"), "\t").alias("header"))
    opens = F.col("value").startswith(f"{FACT}document_id")
    d = running_sum(d, ["file"], "block", "line_no", opens.cast("int"), "ord").withColumn("ord", (F.col("ord") + opens.cast("int")).cast("int")).filter("ord > 0")
    d = d.groupBy("file", "ord").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("ls"))  # one document
    d = d.withColumn("lines", F.transform("ls", lambda x: x["value"])).join(headers, "file", "left")
    lines = F.col("lines")
    told = F.filter(lines, lambda x: x.startswith(FACT) & x.contains("="))
    facts = F.map_from_entries(F.transform(F.reverse(F.array_distinct(F.transform(told, lambda x: F.trim(F.regexp_extract(x, rf"^{FACT}\s*([^=]*?)\s*=", 1))))), lambda k: F.struct(k, F.trim(F.regexp_replace(F.element_at(F.filter(told, lambda x: F.trim(F.regexp_extract(x, rf"^{FACT}\s*([^=]*?)\s*=", 1)) == k), -1), r"^[^=]*=\s*", "")))))
    at = (lambda n: F.array_position("header", n).cast("int") - 1) if dialect == "strict" else (lambda n: F.lit(LOOSE[n]))
    cols = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("TOKEN\t")), lambda x: F.split(x, "\t"))
    if dialect == "strict":
        cols = F.filter(cols, lambda c: F.size(c) > F.coalesce(F.nullif(at("NEL-LIT"), F.lit(-1)), F.lit(7)))
    get = lambda c, n, default: F.coalesce(F.when(at(n) >= 0, F.get(c, at(n))), F.lit(default))
    tokens = F.transform(cols, lambda c: F.struct(get(c, "TOKEN", "").alias("tok"), get(c, "NE-COARSE-LIT", "O").alias("ner"), get(c, "NEL-LIT", "_").alias("nel"), get(c, "NE-FINE-LIT", "_").alias("fine"), get(c, "MISC", "_").contains("NoSpaceAfter").alias("no_space")))
    d = d.select("file", "ord", facts.alias("facts"), tokens.alias("tokens")).filter(F.size("tokens") > 0)
    return d if dialect == "loose" else d.filter(F.size("tokens") > 0)


def offsets(tokens: Column) -> Column:
    """array<struct<tok, start, end>>: places of tokens in the text that they make, one blank after each but where there is none; a fold, no shuffle. tokens: array<struct<tok, no_space>>."""
    none = F.array().cast("array<struct<tok:string,start:int,end:int>>")
    step = lambda acc, t: F.struct((acc["at"] + F.length(t["tok"]) + F.when(t["no_space"], 0).otherwise(1)).alias("at"), F.array_append(acc["out"], F.struct(t["tok"].alias("tok"), acc["at"].alias("start"), (acc["at"] + F.length(t["tok"])).alias("end"))).alias("out"))
    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def spans(d: DataFrame, group: list[str], order: list[str], label: str = "label", strict: bool = True) -> DataFrame:
    """(group, span, type, first, last, n): runs of a tagged sequence. A B- label opens a run; it goes on over I- labels, of its type if strict; what follows a break belongs to none.

    first and last are the values of the first order column.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    opens = F.col(label).startswith("B-")
    d = d.withColumn("span", F.sum(opens.cast("long")).over(w)).filter("span > 0")
    own = Window.partitionBy(*group, "span").orderBy(*order)
    d = d.withColumn("type", F.first(F.expr(f"substr({label}, 3)")).over(own))
    goes_on = opens | ((F.col(label) == F.concat(F.lit("I-"), F.col("type"))) if strict else F.col(label).startswith("I-"))
    d = d.withColumn("broken", F.max((~goes_on).cast("int")).over(own)).filter("broken = 0")
    return d.groupBy(*group, "span").agg(F.first("type").alias("type"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def _linked(tokens: list[dict], strict: bool, window: int) -> list[tuple]:
    label = np.array([t["ner"] for t in tokens], object)
    nel = [t["nel"] for t in tokens]
    length = np.array([len(t["tok"]) for t in tokens])
    gap = np.array([0 if t["no_space"] else 1 for t in tokens])
    start = np.r_[0, np.cumsum(length + gap)[:-1]]
    text = "".join(t["tok"] + (" " if g else "") for t, g in zip(tokens, gap, strict=True))
    if strict and gap[-1]:
        text = text[:-1]
    kind = np.array([x[2:] if x[1:2] == "-" else "" for x in label], object)
    qid = [x.startswith("Q") for x in nel]
    opens = [i for i, x in enumerate(label) if x.startswith("B-") and (strict or qid[i])]
    inside = np.array([x.startswith("I-") for x in label])
    out, done = [], 0
    for i in opens:
        if i < done:
            continue
        rest = inside[i + 1 :] & (kind[i + 1 :] == kind[i] if strict else True)
        done = i + 1 + (int(np.argmin(rest)) if len(rest) and not rest.all() else len(rest))
        ids = [x for x in nel[i:done] if x[:1] == "Q" and x[1:].isdigit()] if strict else [nel[i].split("|")[0].split(",")[0]]
        if not ids:
            continue
        a, z = int(start[i]), int(start[done - 1] + length[done - 1])
        left, right = text[:a], text[z:]
        fine = tokens[i]["fine"]
        fine = fine[2:] if fine[:2] in ("B-", "I-") else ""
        out.append((text[a:z], left[-window:] if window else left, right[:window] if window else right, ids[0], label[i][2:], "" if fine in ("_", "O") else fine, a, z, i))
    return out


def linked_mentions(documents: DataFrame, dialect: str = "strict", window: int = 400) -> DataFrame:
    """A row for each linked mention of documents (facts, tokens), with its document's facts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, ord_, facts, tokens in zip(b["file"], b["ord"], b["facts"], b["tokens"], strict=True):
                f = dict(facts)
                rows += [(file, ord_, f.get("document_id"), f.get("date"), f.get("language"), f.get("dataset"), *m) for m in _linked(list(tokens), dialect == "strict", window)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    OUT = f"file string, document int, doc_id string, date string, language string, dataset string, {MENTION}"
    return documents.mapInPandas(run, OUT)


def with_fine_types(mentions: DataFrame, fine: DataFrame) -> DataFrame:
    """mentions with fine_type joined by document, surface and qid, the last mention of the same three counting; fine: linked_mentions of the loose dialect. An untyped one joins nothing."""
    key = ["doc_id", "mention", "qid"]
    last = fine.groupBy(*key).agg(F.max_by("fine_type", F.struct("file", "document", "ord")).alias("__fine")).filter("__fine <> ''")
    kept = [c for c in mentions.columns if c != "fine_type"]
    own = F.col("fine_type") if "fine_type" in mentions.columns else F.lit(None).cast("string")
    return mentions.withColumn("__own", own).select(*kept, "__own").join(last, key, "left").withColumn("fine_type", F.coalesce("__fine", "__own")).drop("__fine", "__own")


def qid_entities(mentions: DataFrame, labels: DataFrame, lang: str, dataset: str) -> DataFrame:
    """A knowledge base of the qids of mentions (ord: order in the files), numbered by where they first come up. labels: (qid, label, description, aliases), what an outside service told; may lack rows.

    A mark that is no qid stands for nothing known.
    """
    first = mentions.filter(F.coalesce("qid", F.lit("")) != "").groupBy("qid").agg(F.min("ord").alias("ord"))
    d = numbered(first, ["ord", "qid"], "entity_id").withColumn("entity_id", F.col("entity_id").cast("int")).join(labels, "qid", "left")
    nil = ~F.col("qid").startswith("Q")
    title = F.when(nil, F.col("qid")).otherwise(F.coalesce(F.nullif("label", F.lit("")), "qid"))
    about = F.when(nil, F.lit("")).otherwise(F.coalesce("description", F.lit("")))
    return d.select("entity_id", F.col("entity_id").cast("long").alias("pos"), F.concat(F.lit("wikidata:"), "qid").alias("idx"), title.alias("title"), about.alias("entity"), F.btrim(F.concat(title, F.lit("。"), about), F.lit("。")).alias("text"), "qid", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.lit(lang).alias("language"), F.lit(dataset).alias("dataset"), nil.alias("nil"))


def with_entity_numbers(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Gold qids become entity numbers, -1 where the base has none."""
    d = mentions.drop("label_id", "label_title").join(entities.select("qid", F.col("entity_id").alias("label_id"), F.col("title").alias("label_title")), "qid", "left")
    return d.withColumns({"label_id": F.coalesce("label_id", F.lit(-1)), "label_title": F.coalesce("label_title", F.lit(""))})


def with_claims(entities: DataFrame, claims: DataFrame, type_labels: DataFrame) -> DataFrame:
    """wd_type: up to three types' labels; span: the life, else the year of beginning or publication. claims: (qid, types: array, birth, death, inception, publication), type_labels: (type, label)."""
    from ..functions.years import shown_year

    t = claims.select("qid", F.posexplode("types").alias("i", "type")).join(type_labels.filter("label <> ''"), "type")
    t = t.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("ls")).select("qid", F.array_join(F.slice(F.transform("ls", lambda x: x["label"]), 1, 3), "; ").alias("wd_type"))
    show = lambda c: F.coalesce(shown_year(F.nullif(F.col(c), F.lit(0))), F.lit("?"))
    lived = (F.coalesce("birth", F.lit(0)) != 0) | (F.coalesce("death", F.lit(0)) != 0)
    made = F.coalesce(F.nullif("inception", F.lit(0)), "publication")
    c = claims.select("qid", F.when(lived, F.concat(show("birth"), F.lit("-"), show("death"))).otherwise(shown_year(made)).alias("span"))
    return entities.drop("wd_type", "span").join(t, "qid", "left").join(c, "qid", "left")
