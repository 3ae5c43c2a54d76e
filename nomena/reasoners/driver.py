"""Runs a protocol over mentions: one finalist or none needs no model, the others go to it in Arrow batches, row by row within a partition."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import years
from ..operators.kb import KEY, KnowledgeBase, candidate_list, year_scored
from ..operators.ranking import finalists as pick_finalists
from .client import Client
from .protocols import PROTOCOLS

OUT = "pred_id long, transcript string"


def shown_sample(d: DataFrame) -> Column:
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit("Mention: "), e("mention"), F.lit("\nYear: "), F.coalesce(F.col("year").cast("string"), F.lit("unknown")), F.lit("\nContext: "), e("context_left"), F.lit("["), e("mention"), F.lit("]"), e("context_right"))


def cases(kb: KnowledgeBase, mentions: DataFrame, baseline: DataFrame | None = None, method: str = "gather", k: int = 5, sheet: Column | None = None) -> DataFrame:
    """mentions with lead and `finalists`: array<struct<place, id, title, score, active, sheet>>, the lead first, k at most but two at least.

    baseline: (sample_idx, baseline_id); without one, or where it is no candidate, the first candidate leads. sheet: what is shown of an entity, over its columns; else its title, years and text.
    """
    keys = mentions.select(F.col("mention").alias("surface"), "year").distinct()
    pool = candidate_list(kb, keys, method, None)
    scored = year_scored(kb, pool)
    e = kb.entities
    window = years.active_window(F.col("periods"), F.col("birth_year"), F.col("death_year"))
    sheet = sheet if sheet is not None else F.concat_ws("; ", "title", F.concat(F.lit("years="), years.span(F.col("birth_year"), F.col("death_year"))), F.left(F.coalesce("text", F.lit("")), F.lit(260)))
    about = e.select("entity_id", "title", window.alias("window"), sheet.alias("sheet"))
    d = mentions.withColumnRenamed("mention", "surface") if "surface" not in mentions.columns else mentions
    base = baseline if baseline is not None else mentions.select("sample_idx", F.lit(-1).alias("baseline_id")).limit(0)
    rows = d.select("sample_idx", *KEY).join(base, "sample_idx", "left")
    rows = rows.join(scored, [rows["surface"] == scored["surface"], rows["year"].eqNullSafe(scored["year"])]).select("sample_idx", rows["year"].alias("year"), "baseline_id", "entity_id", "score", F.col("rank").alias("r"))
    lead = F.coalesce(F.col("entity_id") == F.col("baseline_id"), F.lit(False))
    top = pick_finalists(rows, ["sample_idx"], lead, [F.col("r")], k).join(about, "entity_id")
    n = rows.groupBy("sample_idx").agg(F.count("*").alias("n_candidates"))
    listed = top.groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("place"), F.col("entity_id").alias("id"), "title", "score", years.active_at(F.col("window"), F.col("year")).alias("active"), "sheet"))).alias("finalists"))
    return mentions.join(listed, "sample_idx", "left").join(n, "sample_idx", "left").join(base, "sample_idx", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def linked(cases_: DataFrame, protocol: str | Callable, make_client: Callable[[], Client], model: str = "", judge: str = "", generic: bool = False, options: dict | None = None) -> DataFrame:
    """Predictions: sample_idx, gold_id, pred_id, pred_id_baseline, n_candidates, is_multi, flipped, transcript.

    Rows of fewer than two candidates keep the baseline, or the only candidate, or -1. make_client is called once in each partition's worker. The call of a row that fails for good gives the lead, and the error stands in the transcript.
    """
    how, options = PROTOCOLS[protocol] if isinstance(protocol, str) else protocol, options or {}
    d = cases_.withColumn("lead", F.element_at("finalists", 1)["id"]).withColumn("is_multi", F.col("n_candidates") >= 2)
    base = F.coalesce("baseline_id", "lead", F.lit(-1)).cast("long")
    shape = ["sample_idx", F.col("label_id").alias("gold_id"), base.alias("pred_id_baseline"), "n_candidates", "is_multi"]
    single = d.filter(~F.col("is_multi")).select(*shape, base.alias("pred_id"), F.lit(None).cast("string").alias("transcript"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def ask(messages: list[dict], temperature: float = 0.0, judge_: str = judge, **kind: bool) -> str:
            return client.complete(messages, (judge_ or model) if kind.get("judge") else model, temperature)

        for b in batches:
            out = []
            for sample, year, fs in zip(b["sample"], b["year"], b["finalists"], strict=True):
                fs = [dict(f.asDict() if hasattr(f, "asDict") else f) for f in fs]
                case = {"sample": sample, "evidence": "\n".join(f"{f['id']}: {f['sheet']}" for f in fs), "finalists": [int(f["id"]) for f in fs], "lead": int(fs[0]["id"]), "scores": {int(f["id"]): f["score"] for f in fs}}
                case |= {"active": {int(f["id"]): bool(f["active"]) for f in fs}, "titles": {int(f["id"]): f["title"] for f in fs}, "year": None if pd.isna(year) else int(year), "generic": generic}
                try:
                    pick, trace = how(ask, case, **options)
                except Exception as e:  # one row's failure must not end the job
                    pick, trace = case["lead"], {"error": repr(e)}
                out.append((int(pick), json.dumps(trace, ensure_ascii=False, default=str)))
            kept = b[["sample_idx", "gold_id", "pred_id_baseline", "n_candidates", "is_multi"]].reset_index(drop=True)
            yield pd.concat([kept, pd.DataFrame(out, columns=["pred_id", "transcript"])], axis=1)

    many = d.filter("is_multi").select(*shape, shown_sample(d).alias("sample"), "year", "finalists")
    types = {f.name: f.dataType.simpleString() for f in many.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ("sample_idx", "gold_id", "pred_id_baseline", "n_candidates", "is_multi"))
    answered = many.mapInPandas(run, f"{schema}, {OUT}")
    return answered.unionByName(single).withColumn("flipped", F.col("is_multi") & ~F.col("pred_id").eqNullSafe(F.col("pred_id_baseline")))


def estimated_cost(cases_: DataFrame, calls: int, unit: float) -> DataFrame:
    """(n, multi, cost): only rows with a choice are asked for."""
    multi = F.coalesce(F.sum((F.col("n_candidates") >= 2).cast("long")), F.lit(0))
    return cases_.agg(F.count("*").alias("n"), multi.alias("multi"), F.round(multi * calls * F.lit(unit), 9).alias("cost"))
