"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each document is due target / source_size copies of itself. The whole part is certain. For the fraction f, a source's documents are dealt to classes of size
(eight to an octave), and in a class every document is due the same number of words, f times the class's mean: its inclusion probability is f * mean / size if f is
at most 1/2, else 1 - (1 - f) * mean / size, so it falls (or rises) with the size and the class's expected words are f times its words. Of each class a fixed number of
documents is drawn: those with the smallest (u / (1 - u)) / (p / (1 - p)), u being a digest of the document's key. The numbers are the class's expected words over its mean,
rounded at random; what rounding leaves is carried on from the largest class to the smallest, so a source ends within about one small document of its target, but for the spread of sizes inside classes.

Cases: a null text has size 0; a null source is a source of its own, last in order; rows of size 0 are drawn like others and
add no words. Repeated rows are rows like any others: which of several equal rows is
taken more often makes no difference. A source without words has target 0 and gives none. Extra columns pass through; those of docs may have any name that doesn't begin with two underscores. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, running, scratch, table, unit, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = "mix-2"
#: Size classes to an octave.
STEPS = 8
#: Rows of a class among which a cut is looked for, about.
FINE = 512
#: Most rows of classes that are broadcast (some 20 MB).
SENT = 200_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size).

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes. A target stops at `most` times its
    source's size and the excess goes to the others by weight until none is above: with the sources by most * size / weight
    ascending, the stopped ones are those whose ratio lies below the level that the rest would get. One row per source
    is all that these windows see.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").cast("long").alias("source_size"))
    code = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(code) - 1) % len(weights)
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    by = by.withColumn("left", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    by = by.withColumn("stopped", F.col("cap") < F.col("left") * F.col("w"))
    first = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("w"), "left"))).over(Window.partitionBy())
    by = by.withColumn("level", first["left"])
    return by.select("source", "n_docs", "source_size", F.when(F.col("stopped") | F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def size_class(size: Column) -> Column:
    """Class of a size: 0 for 0, then STEPS to an octave, by whole numbers only. A class's largest size is less than twice its smallest."""
    octave = (F.length(F.bin(size)) - 1).cast("long")
    return F.when(size <= 0, F.lit(0)).otherwise(octave * STEPS + F.floor(size * STEPS / F.pow(F.lit(2.0), octave)) - STEPS + 1).cast("long")


def _rank(size: Column, f: Column, mean: Column, u: Column) -> tuple[Column, Column]:
    """(inclusion probability, Pareto's rank brought to (0, 1))."""
    rel = F.when(size > 0, mean / size).otherwise(1.0)
    p = F.when(f <= 0.5, f * rel).otherwise(1 - (1 - f) * rel)
    return p, u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def _by(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with the columns of their class; classes: one row for each (__src, __class), broadcast as long as they are few."""
    few = F.broadcast(classes) if classes.count() <= SENT else classes
    return rows.join(few, rows["__source"].eqNullSafe(few["__src"]) & (rows["__cls"] == few["__class"])).drop("__src", "__class")


def class_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """What a document needs to know of its class. rows, written: (__source, __cls, __size, __u).

    (__src, __class, __source_size, __target, __whole, __f, __mean, __take, __cut, __ties, __spare): the class takes the documents whose rank is below __cut and, of
    __ties documents at it, __spare.
    """
    sums = materialize(rows.groupBy("__source", "__cls").agg(F.count("*").alias("n"), F.sum("__size").alias("s")))
    goal = source_targets(sums.select(F.col("__source").alias("source"), F.col("s").alias("size")), weights, 1.0, most).withColumnRenamed("source", "__src").drop("n_docs")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(F.round(due, 9)).cast("int")).withColumn("f", F.greatest(due - F.col("whole"), F.lit(0.0)))
    # from the largest class to the smallest: the number drawn, and the words that rounding leaves; some hundred classes a source at most
    v = unit(F.lit(seed), F.col("__source"), F.col("__cls"))
    held = sums.withColumn("v", v).groupBy("__source").agg(F.array_sort(F.collect_list(F.struct((-F.col("__cls")).alias("c"), "n", "s", "v"))).alias("cs"))
    held = held.join(goal, held["__source"].eqNullSafe(goal["__src"]))
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<c:bigint,n:bigint,s:bigint,take:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        want = F.col("f") * x["s"] + acc["left"]
        number = F.when(x["s"] > 0, F.floor(want * x["n"] / x["s"] + x["v"])).otherwise(F.floor(F.col("f") * x["n"] + x["v"]))
        take = F.when(F.col("f") > 0, F.least(x["n"], F.greatest(F.lit(0), number))).otherwise(0).cast("long")
        return F.struct((want - take * (x["s"].cast("double") / x["n"])).alias("left"), F.array_append(acc["out"], F.struct(x["c"], x["n"], x["s"], take.alias("take"))).alias("out"))

    held = held.withColumn("cs", F.aggregate("cs", start, step)["out"])
    plan = held.select("__src", F.explode("cs").alias("x"), "source_size", "target", "whole", "f")
    plan = plan.select("__src", (-F.col("x.c")).alias("__class"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("f").alias("__f"), (F.col("x.s").cast("double") / F.col("x.n")).alias("__mean"), F.col("x.n").alias("__n"), F.col("x.take").alias("__take"))
    plan = materialize(plan)
    # the rank of the last document drawn: first the slice of ranks that holds it, then its place among the distinct ranks of the slice
    open_ = plan.filter("__take > 0 AND __take < __n").select("__src", "__class", "__f", "__mean", "__n", "__take")
    ranked = _by(rows, open_).withColumn("x", _rank(F.col("__size"), F.col("__f"), F.col("__mean"), F.col("__u"))[1])
    ranked = ranked.withColumn("slice", F.floor(F.col("x") * F.ceil(F.col("__n") / FINE)).cast("long"))
    key = ["__source", "__cls"]
    slices = ranked.groupBy(*key, "slice").agg(F.count("*").alias("m"), F.first("__take").alias("take"))
    upto = Window.partitionBy(*key).orderBy("slice")
    at = slices.withColumn("upto", F.sum("m").over(upto)).filter("upto >= take AND upto - m < take")
    at = materialize(at.select(F.col("__source").alias("__src"), F.col("__cls").alias("__class"), F.col("slice").alias("at"), (F.col("take") - F.col("upto") + F.col("m")).alias("rest")))
    inside = _by(ranked, at).filter("slice = at").groupBy(*key, "x").agg(F.count("*").alias("m"), F.first("rest").alias("rest"))
    last = inside.withColumn("upto", F.sum("m").over(Window.partitionBy(*key).orderBy("x"))).filter("upto >= rest AND upto - m < rest")
    last = last.select(F.col("__source").alias("s"), F.col("__cls").alias("c"), F.col("x").alias("__cut"), F.col("m").alias("__ties"), (F.col("rest") - F.col("upto") + F.col("m")).alias("__spare"))
    out = plan.join(last, plan["__src"].eqNullSafe(last["s"]) & (plan["__class"] == last["c"]), "left").drop("s", "c", "__n")
    return out.withColumn("__cut", F.when(F.col("__cut").isNull(), F.when(F.col("__take") > 0, 2.0).otherwise(-1.0)).otherwise(F.col("__cut")))


def mix(docs: DataFrame, size: Column, key: list[Column], row: str, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED, source: str = "source") -> DataFrame:
    """docs' columns, __size, __source_size, __target, __p (inclusion probability of the fraction), __copies (times that the mix takes the row).

    row: a column that tells rows of equal keys apart. Rows are decided where they are, by what class_plan says of their class; only rows of equal rank at a cut that
    takes some of them are numbered. docs is read several times, but no row of it is moved or written.
    """
    once = lambda x: F.when(F.monotonically_increasing_id() >= 0, x)  # noqa: E731  # or filters that are pushed down would count the words again
    d = docs.withColumns({"__source": F.col(source), "__size": once(size.cast("long")), "__u": once(unit(F.lit(seed), *key))}).withColumn("__cls", size_class(F.col("__size")))
    with scratch(docs.sparkSession):
        slim = materialize(d.select("__source", "__cls", "__size", "__u"))
        plan = materialize(class_plan(slim, weights, most, seed), keep=True)
    d = _by(d, plan)
    p, x = _rank(F.col("__size"), F.col("__f"), F.col("__mean"), F.col("__u"))
    d = d.withColumn("__p", F.when(F.col("__f") > 0, p).otherwise(0.0)).withColumn("__x", F.when((F.col("__cut") >= 0) & (F.col("__cut") <= 1), x).otherwise(0.5))
    out = lambda rows, more: rows.withColumn("__copies", F.col("__whole") + more).drop("__source", "__cls", "__u", "__f", "__mean", "__take", "__cut", "__ties", "__spare", "__x", "__whole")
    below = (F.col("__x") <= F.col("__cut")).cast("int")
    if not plan.filter("__spare < __ties").limit(1).count():
        return out(d, below)
    torn = F.coalesce((F.col("__x") == F.col("__cut")) & (F.col("__spare") < F.col("__ties")), F.lit(False))
    tied = d.filter(torn).select("__source", "__cls", "__ties", "__spare", row)
    with scratch(docs.sparkSession):
        tied = tied.withColumn("__bucket", F.pmod(F.xxhash64(row), F.ceil(F.sqrt(F.col("__ties")))))
        numbers = running(materialize(tied), ["__source", "__cls"], "__bucket", [F.col(row)], F.lit(1), "__at")
        chosen = materialize(numbers.filter("__at < __spare").select(F.col(row).alias("__row")), keep=True)
    some = d.filter(torn).join(chosen, F.col(row) == F.col("__row"), "left")
    return out(d.filter(~torn), below).unionByName(out(some, F.col("__row").isNotNull().cast("int")).drop("__row"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    slim = materialize(d.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    out = mix(slim, F.col("size"), [F.col("doc_id"), F.col("digest")], "row")
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("size")).cast("long").alias("taken"))


ORACLE_OP10 = f"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '~') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM documents),
d AS MATERIALIZED (
    SELECT *, CASE WHEN size <= 0 THEN 0 ELSE (length(bin(size)) - 1) * {STEPS} + size * {STEPS} // (1::BIGINT << (length(bin(size)) - 1)) - {STEPS} + 1 END AS cls
    FROM docs),
sums AS MATERIALIZED (SELECT source, cls, count(*) AS n, sum(size)::BIGINT AS s FROM d GROUP BY ALL),
src AS (SELECT source, sum(s)::BIGINT AS source_size, sum(s)::DOUBLE * {MOST} AS cap FROM sums GROUP BY ALL),
weighed AS (
    SELECT *, ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)}]::DOUBLE AS w
    FROM src),
levels AS (
    SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM weighed),
leveled AS (SELECT *, cap < rest * w AS stopped, (SELECT arg_min(rest, cap / w) FROM levels WHERE NOT cap < rest * w) AS level FROM levels),
goal AS (SELECT source, source_size, CASE WHEN stopped OR level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM leveled),
due AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r FROM goal),
parts AS (SELECT *, floor(round(r, 9))::INT AS whole, greatest(r - floor(round(r, 9))::INT, 0.0) AS f FROM due),
held AS MATERIALIZED (
    SELECT p.*, x.cls, x.n, x.s, row_number() OVER (PARTITION BY x.source ORDER BY x.cls DESC) AS k,
        (('0x' || substr(md5('{SEED}:' || coalesce(x.source, '~') || ':' || x.cls), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS v
    FROM sums x JOIN parts p ON x.source IS NOT DISTINCT FROM p.source),
fold AS (
    SELECT source, 0::BIGINT AS k, 0::BIGINT AS cls, 0::BIGINT AS take, 0.0::DOUBLE AS rest FROM parts
    UNION ALL
    SELECT source, k, cls, take, want - take * (s::DOUBLE / n) FROM (
        SELECT *, CASE WHEN f > 0 THEN least(n, greatest(0, CASE WHEN s > 0 THEN floor(want * n / s + v) ELSE floor(f * n + v) END))::BIGINT ELSE 0 END AS take FROM (
            SELECT h.*, h.f * h.s + fold.rest AS want FROM fold JOIN held h ON h.source IS NOT DISTINCT FROM fold.source AND h.k = fold.k + 1))),
joined AS (
    SELECT d.*, h.source_size, h.target, h.whole, h.f, fold.take, CASE WHEN d.size > 0 THEN (h.s::DOUBLE / h.n) / d.size ELSE 1.0 END AS rel
    FROM d JOIN held h ON d.source IS NOT DISTINCT FROM h.source AND d.cls = h.cls
    JOIN fold ON h.source IS NOT DISTINCT FROM fold.source AND h.k = fold.k),
odds AS (SELECT *, CASE WHEN f <= 0.5 THEN f * rel ELSE 1 - (1 - f) * rel END AS p FROM joined),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, cls ORDER BY u * (1 - p) / (u * (1 - p) + (1 - u) * p)) AS spot FROM odds)
SELECT doc_id, size, source_size, target, ((whole + (spot <= take)::INT) * size)::BIGINT AS taken FROM placed
"""
