"""Scoring of predictions, with identities, and the counts around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, years
from .canon import canon_map

#: Where the list of names begins in an entity's text, and how short it may not be.
NAMES_FROM, SHORTEST = "名乗期間", 30


def text_signature(c: Column) -> Column:
    """The names told by the text, without white space: null if there are none, or too few characters, or no year."""
    at = F.instr(F.coalesce(c, F.lit("")), NAMES_FROM)
    part = F.regexp_replace(F.substr(c, at), rf"{text.UNICODE}{text.SPACE}+", "")
    return F.when((at > 0) & (F.length(part) > SHORTEST) & part.rlike(r"（\d{3,4}）"), part)


def period_signature(periods: Column, body: Column) -> Column:
    """What tells that two records are one person: all dated names in order, if any has a year; an entity without dated names is told by its text."""
    none = F.coalesce(F.size(periods), F.lit(0)) <= 0
    dated = F.exists(periods, lambda p: years.known(p["start_year"]).isNotNull() | years.known(p["end_year"]).isNotNull())
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("-"))  # noqa: E731  # a bound of 0 is not a missing one here
    rows = F.transform(periods, lambda p: F.concat_ws("\u0001", F.regexp_replace(e(p["name"]), rf"{text.UNICODE}{text.SPACE}", ""), e(p["daime"]), number(p["start_year"]), number(p["end_year"]), e(p["name_type"])))
    return F.when(none, F.concat(F.lit("t:"), text_signature(body))).when(dated, F.concat(F.lit("p:"), F.array_join(rows, "\u0002")))


def identities(entities: DataFrame, mode: str = "full") -> DataFrame:
    """(entity_id, canon_id). Mode none joins nothing, source the records of one source, full also those of one signature and life. Where the base has cluster ids, these decide."""
    if mode == "none":
        return entities.select("entity_id", F.col("entity_id").alias("canon_id"))
    if entities.filter("cluster_id IS NOT NULL").limit(1).count():
        return entities.select("entity_id", F.coalesce("cluster_id", "entity_id").alias("canon_id"))
    keys = [F.col("idx").cast("string")]
    if mode == "full":
        life = F.concat_ws("|", F.coalesce(F.col("birth_year").cast("string"), F.lit("-")), F.coalesce(F.col("death_year").cast("string"), F.lit("-")))
        keys.append(F.sha2(F.concat(period_signature(F.col("periods"), F.col("text")), F.lit("|"), life), 256))
    return canon_map(entities, keys)


def judged(items: DataFrame, preds: DataFrame, entities: DataFrame, canon: DataFrame) -> DataFrame:
    """items (sample_idx, label_id, type) with `missing`, id_ok and title_ok.

    Predictions are joined by position in the file. One of -1 with a title is resolved through the titles, to the smallest id; ids are compared by identity, an unknown id standing for itself.
    """
    titles = entities.select("entity_id", text.squeeze("title").alias("t"))
    by_title = titles.groupBy("t").agg(F.min("entity_id").alias("by_title"))
    d = items.join(preds.select("sample_idx", "pred_id", "pred_title", F.lit(True).alias("here")), "sample_idx", "left")
    d = d.withColumn("t", text.squeeze("pred_title")).join(by_title, "t", "left").drop("t")
    raw = F.coalesce("pred_id", F.lit(-1))
    d = d.withColumn("p", F.when((raw == -1) & F.col("pred_title").isNotNull(), F.coalesce("by_title", F.lit(-1))).otherwise(raw))
    for c, out in (("p", "cp"), ("label_id", "cg")):
        d = d.join(canon.select(F.col("entity_id").alias(c), F.col("canon_id").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))
    for c, out in (("p", "tp"), ("label_id", "tg")):
        d = d.join(titles.select(F.col("entity_id").alias(c), F.col("t").alias(out)), c, "left")
    told = F.when(F.col("p") != -1, F.coalesce("tp", F.lit(""))).otherwise(text.squeeze("pred_title"))
    here = F.coalesce("here", F.lit(False))
    same = F.col("cp").eqNullSafe(F.col("cg"))
    return d.select("sample_idx", F.coalesce("type", F.lit("?")).alias("type"), (~here).alias("missing"), (here & same).alias("id_ok"), (here & (told != "") & (told == F.coalesce("tg", F.lit("")))).alias("title_ok"))


def totals(d: DataFrame) -> DataFrame:
    """Over all items; missing predictions are wrong ones."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return d.agg(F.count("*").alias("n"), n("missing").alias("missing"), n("id_ok").alias("id_correct"), n("title_ok").alias("title_correct"))


def by_type(d: DataFrame) -> DataFrame:
    """By type; missing predictions don't count."""
    return d.filter("NOT missing").groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("id_ok").cast("long")).alias("id_correct"), F.sum(F.col("title_ok").cast("long")).alias("title_correct")).orderBy(F.desc("n"), "type")


def multi_candidate_only(items: DataFrame, built: DataFrame) -> DataFrame:
    """Items whose (mention, label, last 100 characters of the left context) had more than one candidate when the corpus was built. built: (mention, ans_id, left_context, candidates)."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = lambda label, left: F.struct(e("mention").alias("m"), F.coalesce(F.col(label).cast("long"), F.lit(-(1 << 62))).alias("l"), F.right(e(left), F.lit(100)).alias("c"))
    many = built.filter(F.size("candidates") > 1).select(key("ans_id", "left_context").alias("k")).distinct()
    return items.withColumn("k", key("label_id", "context_left")).join(many, "k", "left_semi").drop("k")


def arms(d: DataFrame, correct: list[str], ambiguous: str = "ambiguous") -> DataFrame:
    """(subset, n, accuracy of each arm) over all items and the ambiguous ones."""
    d = d.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col(ambiguous), F.lit("ambiguous"))))).filter("subset IS NOT NULL")
    return d.groupBy("subset").agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 9).alias(c) for c in correct])


def run_counts(d: DataFrame) -> DataFrame:
    """Of predictions (pred_id, gold_id, pred_id_baseline, is_multi, flipped): items, multi-candidate ones, flips, flips by outcome, correct before and after."""
    ok, was = F.col("pred_id").eqNullSafe(F.col("gold_id")), F.col("pred_id_baseline").eqNullSafe(F.col("gold_id"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    f = F.coalesce("flipped", F.lit(False))
    return d.agg(F.count("*").alias("n"), n(F.coalesce("is_multi", F.lit(False))).alias("multi"), n(f).alias("flipped"), n(f & was & ~ok).alias("right_to_wrong"), n(f & ~was & ok).alias("wrong_to_right"), n(was).alias("baseline_correct"), n(ok).alias("correct"))


def cost_rollup(d: DataFrame, unit: float) -> DataFrame:
    """(tier, method, items, cost) with subtotals by tier and in all. d: (tier, method, calls, items)."""
    return d.groupBy("tier", "method", "calls", "items").agg(F.lit(1).alias("x")).rollup("tier", "method").agg(F.sum("items").alias("items"), F.round(F.sum(F.col("calls") * F.col("items") * F.lit(unit)), 9).alias("cost"))


def by_difficulty(d: DataFrame) -> DataFrame:
    """(n_candidates, n, correct): accuracy by the number of candidates, those of ten and more together."""
    return d.groupBy(F.least(F.col("n_candidates"), F.lit(10)).alias("n_candidates")).agg(F.count("*").alias("n"), F.sum(F.col("id_ok").cast("long")).alias("correct"))


def leaderboard(d: DataFrame) -> DataFrame:
    """(method, n, correct, accuracy), best first; d: (method, id_ok)."""
    g = d.groupBy("method").agg(F.count("*").alias("n"), F.sum(F.col("id_ok").cast("long")).alias("correct"))
    return g.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 9)).orderBy(F.desc("accuracy"), "method")
