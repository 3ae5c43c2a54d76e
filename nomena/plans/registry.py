"""Named queries on the driver's tables, each with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, years
from ..operators import candidates, canon, numbering, ranking, tokens
from ..operators.storage import written
from ..streaming import events as streams
from . import fixtures as fx
from .fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, linked: bool = True):
    """Registers a query with its SQL; linked: the SQL reads the linking fixtures."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = (f"WITH {fx.SQL}" + (", " + body[5:] if body.startswith("WITH ") else " " + body)) if linked else body
        return f

    return add


def _all(spark, sf):
    return fx.mentions(spark, sf), fx.entities(spark, sf), fx.periods(spark, sf)


@query("SELECT DISTINCT surface, year, entity_id FROM mentions JOIN entities ON title = surface")
def surface_exact(spark, sf):
    m, e, _ = _all(spark, sf)
    return candidates.by_title(candidates.mention_keys(m), e).select("surface", "year", "entity_id")


@query("SELECT surface, year, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY surface, year ORDER BY entity_id) AS r FROM (SELECT DISTINCT surface, m.year, entity_id FROM mentions m JOIN periods ON name = surface AND m.year BETWEEN start_year AND end_year)) WHERE r <= 30")
def alias_at_year(spark, sf):
    m, _, p = _all(spark, sf)
    return candidates.by_alias_year(candidates.mention_keys(m), p).select("surface", "year", "entity_id")


@query("WITH b AS (SELECT string_split(title, ' ')[1] AS base, entity_id, row_number() OVER (PARTITION BY string_split(title, ' ')[1] ORDER BY entity_id) AS r FROM entities), k AS (SELECT DISTINCT surface, year FROM mentions) SELECT surface, year, entity_id FROM k JOIN b ON base = string_split(surface, ' ')[1] WHERE r <= 30")
def family_pool(spark, sf):
    m, e, _ = _all(spark, sf)
    return candidates.by_family(candidates.mention_keys(m), e).select("surface", "year", "entity_id")


@query("WITH s AS (SELECT DISTINCT string_split(surface, ' ')[1] AS surface FROM mentions), t AS (SELECT DISTINCT title FROM entities) SELECT surface, title, rank FROM (SELECT surface, title, CAST(row_number() OVER (PARTITION BY surface ORDER BY title) AS INT) AS rank FROM s JOIN t ON contains(title, surface) OR contains(surface, title) WHERE length(surface) >= 2) WHERE rank <= 30")
def substring_search(spark, sf):
    m, e, _ = _all(spark, sf)
    return candidates.by_substring(m.select(F.substring_index("surface", " ", 1).alias("surface")), e.select("title"))


@query("WITH s AS (SELECT DISTINCT title FROM entities) SELECT a.title AS a, b.title AS b, CAST(levenshtein(a.title, b.title) AS INT) AS distance FROM s a JOIN s b ON a.title <> b.title WHERE levenshtein(a.title, b.title) <= 6")
def levenshtein_candidates(spark, sf):
    """All pairs of titles within six edits, both ways."""
    d = candidates.within_edits(fx.entities(spark, sf).select("title").distinct(), "title", 6)
    return d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


@query("SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * v.embedding[i])), 5) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * v.embedding[i])), 5) DESC, v.vec_id) AS INT) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10", linked=False)
def dense_topk(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return candidates.dense_top_k(v.filter("vec_id % 50 = 0"), v, 10)


_TITLE = "SELECT sample_key, CASE WHEN min(CASE WHEN entity_id = gold_id THEN 0 ELSE 1 END) = 0 THEN any_value(gold_id) ELSE min(entity_id) END AS id FROM mentions JOIN entities ON title = surface GROUP BY sample_key"


@query(_TITLE)
def title_resolution(spark, sf):
    """A title resolves to the gold id if it is among its ids (compatible mode), else to the smallest."""
    m, e, _ = _all(spark, sf)
    ids = e.groupBy("title").agg(F.min("entity_id").alias("least"))
    gold = e.select(F.col("title").alias("surface"), F.col("entity_id").alias("gold_id"), F.lit(True).alias("among"))
    d = m.join(ids, F.col("surface") == F.col("title")).join(gold, ["surface", "gold_id"], "left")
    return d.dropDuplicates(["sample_key"]).select("sample_key", F.when(F.col("among"), F.col("gold_id")).otherwise(F.col("least")).alias("id"))


_NAME = "SELECT entity_id, y AS year, (SELECT name FROM periods p WHERE p.entity_id = e.entity_id AND y BETWEEN start_year AND end_year ORDER BY seg LIMIT 1) AS name FROM (SELECT entity_id, unnest([1996, 1998, 2000]) AS y FROM entities) e"


@query(_NAME)
def evidence_name_at_year(spark, sf):
    """The first dated name that covers the year, by a higher-order filter over the entity's own periods."""
    _, e, p = _all(spark, sf)
    own = p.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("seg", "name", "start_year", "end_year"))).alias("ps"))
    d = e.join(own, "entity_id", "left").withColumn("year", F.explode(F.array(F.lit(1996), F.lit(1998), F.lit(2000))))
    hit = F.filter("ps", lambda x: years.covers(x["start_year"], x["end_year"], F.col("year")))
    return d.select("entity_id", "year", F.get(hit, F.lit(0))["name"].alias("name"))


@query("SELECT entity_id, left(concat_ws('; ', 'title=' || title, 'type=' || category, 'generation=' || generation, 'active=' || birth_year || '-' || death_year), 260) AS sheet FROM entities")
def evidence_render(spark, sf):
    """Only listed fields, in fixed order, cut at 260 characters."""
    e = fx.entities(spark, sf)
    part = lambda k, c: F.concat(F.lit(f"{k}="), c)
    sheet = F.concat_ws("; ", part("title", F.col("title")), part("type", F.col("category")), part("generation", F.col("generation").cast("string")), part("active", F.concat("birth_year", F.lit("-"), "death_year")))
    return e.select("entity_id", F.left(sheet, F.lit(260)).alias("sheet"))


@query("SELECT entity_id, string_agg(name || '(' || start_year || '-' || end_year || ')', ', ' ORDER BY seg) AS names FROM periods GROUP BY entity_id")
def evidence_periods(spark, sf):
    p = fx.periods(spark, sf)
    listed = F.array_sort(F.collect_list(F.struct("seg", F.concat("name", F.lit("("), "start_year", F.lit("-"), "end_year", F.lit(")")).alias("s"))))
    return p.groupBy("entity_id").agg(F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("names"))


@query("SELECT entity_id, CASE WHEN birth_year IS NULL AND death_year IS NULL THEN '?' ELSE coalesce(CAST(birth_year AS VARCHAR), '?') || '–' || coalesce(CAST(death_year AS VARCHAR), '?') END AS span FROM entities")
def evidence_spans(spark, sf):
    return fx.entities(spark, sf).select("entity_id", years.span(F.col("birth_year"), F.col("death_year")).alias("span"))


_CANON = """WITH RECURSIVE part_keys AS (SELECT p_partkey AS id, '0:' || p_brand || '|' || p_type || '|' || p_size AS k FROM part{more}),
edges AS (SELECT DISTINCT a.id AS a, b.id AS b FROM part_keys a JOIN part_keys b ON a.k = b.k),
reach AS (SELECT p_partkey AS a, p_partkey AS b FROM part UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT a AS entity_id, min(b) AS canon_id FROM reach GROUP BY a"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """What identities are told by: columns of part alone."""
    return table(spark, sf, "part").selectExpr("p_partkey AS entity_id", "p_name AS title", "p_type AS category", "p_brand AS source", "p_size AS size")


@query(_CANON.format(more=""), linked=False)
def canon_source(spark, sf):
    e = _records(spark, sf)
    return canon.canon_map(e, [F.concat_ws("|", "source", "category", "size")])


@query(_CANON.format(more=" UNION SELECT p_partkey, '1:' || p_name || '|' || p_type || '|' || p_size FROM part"), linked=False)
def canon_full(spark, sf):
    e = _records(spark, sf)
    return canon.canon_map(e, [F.concat_ws("|", "source", "category", "size"), F.concat_ws("|", "title", "category", "size")])


@query("SELECT surface, type, gold_id, sample_key FROM (SELECT *, row_number() OVER (PARTITION BY surface, type, gold_id ORDER BY year, sample_key) AS r FROM mentions) WHERE r = 1")
def dedup_keep_first(spark, sf):
    return ranking.keep_first(fx.mentions(spark, sf), ["surface", "type", "gold_id"], ["year", "sample_key"]).select("surface", "type", "gold_id", "sample_key")


@query("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND quality <> -1", linked=False)
def clean_no_gold(spark, sf):
    return table(spark, sf, "labels").filter("quality IS NOT NULL AND quality <> -1").select("doc_id", "quality")


@query("SELECT surface, count(DISTINCT gold_id) AS n FROM mentions GROUP BY surface HAVING count(DISTINCT gold_id) >= 2")
def ambiguous_surfaces(spark, sf):
    return fx.mentions(spark, sf).groupBy("surface").agg(F.count_distinct("gold_id").alias("n")).filter("n >= 2")


@query("SELECT sample_key, CASE WHEN n >= 2 THEN 'multi' ELSE '' END AS tags FROM mentions JOIN (SELECT surface, year, count(DISTINCT gold_id) AS n FROM mentions GROUP BY 1, 2) USING (surface, year)")
def tag_multi(spark, sf):
    m = fx.mentions(spark, sf)
    n = m.groupBy("surface", "year").agg(F.count_distinct("gold_id").alias("n"))
    tags = F.when(F.col("n") >= 2, F.array_sort(F.array_union(F.array().cast("array<string>"), F.array(F.lit("multi"))))).otherwise(F.array().cast("array<string>"))
    return m.join(n, ["surface", "year"]).select("sample_key", F.array_join(tags, ",").alias("tags"))


def _split(key: str, least: str) -> str:
    return f"""WITH k AS (SELECT DISTINCT {key} AS k FROM mentions), r AS (SELECT k, row_number() OVER (ORDER BY md5('42:' || k), k) AS r, count(*) OVER () AS n FROM k)
SELECT k AS split_key, CASE WHEN r <= {least} THEN 'test' WHEN r <= 2 * {least} THEN 'valid' ELSE 'train' END AS split FROM r"""


def _cuts(d: DataFrame, ranks: list[int]) -> list[Column]:
    """For each rank n, whether (h, split_key) is among the n smallest. Digests are counted by their first letters, once for all ranks; then only the slice where a rank falls is sorted, as far as it is needed."""
    counts = sorted((r["p"], r["count"]) for r in d.groupBy(F.left("h", F.lit(4)).alias("p")).count().collect())  # 65,536 at most
    out = []
    for n in ranks:
        left = n
        for prefix, count in counts:
            if count >= left:
                break
            left -= count
        if n <= 0 or not counts:
            out.append(F.lit(False))
            continue
        cut = d.filter(F.left("h", F.lit(4)) == prefix).orderBy("h", "split_key").limit(left).agg(F.max(F.struct("h", "split_key")).alias("m")).first()["m"]
        out.append(F.struct("h", "split_key") <= F.struct(F.lit(cut["h"]), F.lit(cut["split_key"])))
    return out


def _hash_split(keys: DataFrame, least: int) -> DataFrame:
    """First int(n / 10) keys by seeded digest are test, the next valid, the rest train."""
    d = written(keys.distinct().withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("split_key")).cast("binary"))))
    n = max(least, int(d.count() * 0.1))
    test, valid = _cuts(d, [n, 2 * n])
    return d.select("split_key", F.when(test, "test").when(valid, "valid").otherwise("train").alias("split"))


@query(_split("surface || '|' || gold_id", "CAST(floor(n * 0.1) AS BIGINT)"))
def split_pair(spark, sf):
    return _hash_split(fx.mentions(spark, sf).select(F.concat_ws("|", "surface", "gold_id").alias("split_key")), 0)


@query(_split("CAST(gold_id AS VARCHAR)", "greatest(1, CAST(floor(n * 0.1) AS BIGINT))"))
def split_entity(spark, sf):
    return _hash_split(fx.mentions(spark, sf).select(F.col("gold_id").cast("string").alias("split_key")), 1)


@query("SELECT CASE WHEN year >= 2000 THEN 'test' WHEN year = 1999 THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM mentions GROUP BY 1")
def split_temporal(spark, sf):
    split = F.when(F.col("year") >= 2000, "test").when(F.col("year") == 1999, "valid").otherwise("train")
    return fx.mentions(spark, sf).groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query("SELECT book, n, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS split FROM (SELECT coalesce(book, '?') AS book, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(book, '?')) AS r FROM mentions GROUP BY 1)")
def split_book(spark, sf):
    """Largest book test, second valid, ties by name: two rows decide, so they are taken by a top-k, not by a global window."""
    n = fx.mentions(spark, sf).groupBy(F.coalesce("book", F.lit("?")).alias("book")).agg(F.count("*").alias("n"))
    top = [r[0] for r in n.orderBy(F.desc("n"), "book").limit(2).collect()] + [None, None]
    return n.withColumn("split", F.when(F.col("book") == F.lit(top[0]), "test").when(F.col("book") == F.lit(top[1]), "valid").otherwise("train"))


@query("WITH s AS (SELECT surface, gold_id, CASE WHEN year >= 2000 THEN 'test' WHEN year = 1999 THEN 'valid' ELSE 'train' END AS split FROM mentions), t AS (SELECT DISTINCT surface, gold_id FROM s WHERE split = 'train') SELECT count(*) AS n, count(t.gold_id) AS leaked FROM s LEFT JOIN t USING (surface, gold_id) WHERE split = 'test'")
def split_leak(spark, sf):
    m = fx.mentions(spark, sf)
    train = m.filter("year < 1999 OR year IS NULL").select("surface", "gold_id", F.lit(True).alias("seen")).distinct()
    return m.filter("year >= 2000").join(train, ["surface", "gold_id"], "left").agg(F.count("*").alias("n"), F.sum(F.col("seen").isNotNull().cast("long")).alias("leaked"))


@query("WITH k AS (SELECT DISTINCT surface, year FROM mentions), c AS (SELECT surface, year, e.entity_id, CASE WHEN year BETWEEN birth_year AND death_year THEN 16 ELSE 0 END AS flags, coalesce(abs(year * 2 - birth_year - death_year), 1000000000) AS distance FROM k JOIN entities e ON title = surface) SELECT surface, year, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY surface, year ORDER BY flags DESC, distance, entity_id) AS r FROM c) WHERE r = 1")
def relink_argmax(spark, sf):
    """Best flags, then the smallest distance of the year to the middle of the lifetime, then the smallest id."""
    m, e, _ = _all(spark, sf)
    c = candidates.by_title(candidates.mention_keys(m), e).join(e.select("entity_id", "birth_year", "death_year"), "entity_id")
    flags = F.when(years.covers(F.col("birth_year"), F.col("death_year"), F.col("year")), 16).otherwise(0)
    distance = F.coalesce(F.abs(F.col("year") * 2 - F.col("birth_year") - F.col("death_year")), F.lit(1_000_000_000))
    return c.groupBy("surface", "year").agg(F.min_by("entity_id", F.struct(-flags, distance, "entity_id")).alias("entity_id"))


@query("SELECT entity_id, lpad(bin(f), 7, '0') AS flags FROM (SELECT entity_id, (CASE WHEN generation <= 3 THEN 4 ELSE 0 END) | (CASE WHEN birth_year BETWEEN 1990 AND 1997 THEN 8 ELSE 0 END) | (CASE WHEN 1998 BETWEEN birth_year AND death_year THEN 16 ELSE 0 END) AS f FROM entities)")
def match_flags(spark, sf):
    e = fx.entities(spark, sf)
    f = years.match_flags(F.lit(False), F.col("generation") <= 3, F.col("birth_year").between(1990, 1997), years.covers(F.col("birth_year"), F.col("death_year"), F.lit(1998)))
    return e.select("entity_id", years.shown_bits(f).alias("flags"))


@query("WITH k AS (SELECT DISTINCT surface, year FROM mentions), c AS (SELECT surface, year, count(*) AS n, sum(CASE WHEN year BETWEEN birth_year - 5 AND death_year + 5 THEN 1 ELSE 0 END) AS active FROM k JOIN entities e ON title = surface GROUP BY 1, 2) SELECT CASE WHEN n = 1 THEN 'unique' WHEN active = 1 THEN 'active' WHEN active = 0 THEN 'unresolved' ELSE 'ambiguous' END AS outcome, count(*) AS n FROM mentions JOIN c USING (surface, year) GROUP BY 1")
def resolve_ladder(spark, sf):
    """Candidates are counted once per (surface, year), not per mention."""
    m, e, _ = _all(spark, sf)
    active = F.col("year").between(F.col("birth_year") - 5, F.col("death_year") + 5)
    c = candidates.by_title(candidates.mention_keys(m), e).join(e.select("entity_id", "birth_year", "death_year"), "entity_id")
    c = c.groupBy("surface", "year").agg(F.count("*").alias("n"), F.sum(F.when(active, 1).otherwise(0)).alias("active"))
    outcome = F.when(F.col("n") == 1, "unique").when(F.col("active") == 1, "active").when(F.col("active") == 0, "unresolved").otherwise("ambiguous")
    return m.join(c, ["surface", "year"]).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, right(coalesce(text, ''), 40) AS l, left(coalesce(text, ''), 40) AS r FROM documents", linked=False)
def window_context(spark, sf):
    d = table(spark, sf, "documents")
    left, right = text.window_context(F.col("text"), F.col("text"), 40)
    return d.select("doc_id", left.alias("l"), right.alias("r"))


@query("SELECT sample_key, ' [年:' || CASE WHEN coalesce(year, 0) = 0 THEN '?' ELSE CAST(year AS VARCHAR) END || '|書:' || replace(coalesce(book, ''), '|', '/') || '] ' AS token FROM mentions")
def year_token(spark, sf):
    return fx.mentions(spark, sf).select("sample_key", text.year_token(F.col("year"), F.col("book")).alias("token"))


_ENDS = text.ENDS.replace("'", "''")


@query(f"WITH t AS (SELECT doc_id, left(lower(coalesce(lang, '')), 2) AS l, text FROM documents), n AS (SELECT doc_id, l, trim(trim(regexp_replace(CASE WHEN l = 'sa' THEN coalesce(text, '') ELSE lower(coalesce(text, '')) END, '\\s+', ' ', 'g')), '{_ENDS}') AS t FROM t) SELECT doc_id, CASE WHEN l IN ('fi', 'sa') THEN t ELSE translate(CASE WHEN l = 'de' THEN replace(t, 'ß', 'ss') ELSE t END, '{text.WITH_DIACRITICS}', '{text.WITHOUT}') END AS norm FROM n", linked=False)
def normalize_generic(spark, sf):
    """Whole texts by their language, in the JVM: letters beyond the table keep their marks here."""
    return table(spark, sf, "documents").select("doc_id", text.normalize_generic("text", "lang", text.fold_known).alias("norm"))


@query("SELECT entity_id, translate(title, ' ', '') AS norm, title AS base FROM entities")
def normalize_name(spark, sf):
    return fx.entities(spark, sf).select("entity_id", text.normalize_name("title").alias("norm"), text.mention_base("title").alias("base"))


_WRITTEN = "CASE length(sample_key) % 3 WHEN 0 THEN ' \"' || upper(surface) || '\"' WHEN 1 THEN surface || ' ' ELSE surface END"


@query(f"SELECT surface, entity_id, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY surface) AS DOUBLE), 9) AS p FROM (SELECT gold_id AS entity_id, translate(lower(trim({_WRITTEN})), '\"', '') AS surface FROM mentions) GROUP BY surface, entity_id")
def pem_prior(spark, sf):
    """Surfaces written in capitals, in quotes or with blanks are counted under one form."""
    return candidates.prior(fx.mentions(spark, sf).withColumn("surface", F.expr(_WRITTEN)))


@query("SELECT surface, entity_id FROM (SELECT surface, gold_id AS entity_id, row_number() OVER (PARTITION BY surface ORDER BY count(*) DESC, gold_id) AS r FROM mentions GROUP BY surface, gold_id) WHERE r = 1")
def pem_argmax(spark, sf):
    n = fx.mentions(spark, sf).groupBy("surface", "gold_id").agg(F.count("*").alias("n"))
    return n.groupBy("surface").agg(F.min_by("gold_id", F.struct(-F.col("n"), "gold_id")).alias("entity_id"))


@query("WITH t AS (SELECT DISTINCT string_split(title, ' ') AS w FROM entities), p AS (SELECT w, unnest(range(0, len(w))) AS i FROM t) SELECT array_to_string(w[1:i], ' ') AS prefix, w[i + 1] AS next FROM p GROUP BY 1, 2")
def trie_next(spark, sf):
    w = F.split("title", " ")
    d = fx.entities(spark, sf).select("title").distinct().select(w.alias("w"), F.posexplode(w).alias("i", "next"))
    return d.select(F.array_join(F.slice("w", F.lit(1), F.col("i")), " ").alias("prefix"), "next").distinct()


@query("SELECT doc_id, i AS tok_idx, tok, start FROM (SELECT doc_id, i, toks[i] AS tok, CAST(coalesce(sum(length(toks[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, string_split(text, ' ') AS toks FROM documents) d, range(1, len(toks) + 1) t(i))", linked=False)
def token_offsets(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("i", "tok")).withColumn("tok_idx", (F.col("i") + 1).cast("long"))
    return d.select("doc_id", "tok_idx", "tok", F.coalesce(F.sum(F.length("tok") + 1).over(w), F.lit(0)).cast("long").alias("start"))


_BIO = """WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'B-' WHEN event_id % 7 = 0 THEN 'O-' ELSE 'I-' END || event_type AS label FROM events),
o AS (SELECT *, sum(CASE WHEN label LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS span FROM t),
k AS (SELECT *, first_value(substr(label, 3)) OVER (PARTITION BY user_id, span ORDER BY event_id) AS type FROM o WHERE span > 0),
b AS (SELECT *, max(CASE WHEN label LIKE 'B-%' OR label = 'I-' || type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, span ORDER BY event_id) AS broken FROM k)
SELECT user_id, CAST(span AS BIGINT) AS span, any_value(type) AS type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b WHERE broken = 0 GROUP BY user_id, span"""


@query(_BIO, linked=False)
def bio_spans(spark, sf):
    """Spans of a tagged sequence: a user's events with labels made from their ids, so that all ways to begin, go on and break occur."""
    label = F.concat(F.when(F.col("event_id") % 3 == 0, "B-").when(F.col("event_id") % 7 == 0, "O-").otherwise("I-"), "event_type")
    return tokens.spans(table(spark, sf, "events").select("user_id", "event_id", label.alias("label")), ["user_id"], ["event_id"])


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links, coalesce(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)[1], '') AS first_link FROM pages", linked=False)
def html_title_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", linked=False)
def json_answer(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object(text.outer_json("props"), "$.k").cast("long").alias("k"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS number FROM events", linked=False)
def numbered_events(spark, sf):
    """All events numbered in order of time, without one task that sees them all."""
    return numbering.numbered(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], "number").select("event_id", "number")


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER w AS carried, CAST(coalesce(sum(length(props)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", linked=False)
def carried_events(spark, sf):
    """The last marked type of each user's events so far, and running lengths of all events of a type, scanned in blocks of a thousand ids."""
    d = table(spark, sf, "events").withColumn("block", F.floor(F.col("event_id") / 1000))
    d = numbering.carried(d, ["user_id"], "block", "event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")), "carried")
    return numbering.running_sum(d, ["event_type"], "block", "event_id", F.length("props"), "start").select("event_id", "carried", F.col("start").cast("long").alias("start"))


@query("SELECT user_id, event_type, n AS votes FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(ts) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1", linked=False)
def majority_vote(spark, sf):
    return ranking.majority(table(spark, sf, "events"), ["user_id"], "event_type", [F.max("ts")]).select("user_id", "event_type", "votes")


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY round(max(value), 6) DESC, count(*) DESC, event_type DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 1", linked=False)
def rerank_argmax(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.max("value"), 6).alias("q"), F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("q", "n", "event_type")).alias("event_type"))


@query("SELECT event_type, k % 3 AS tier, count(*) AS calls, round(count(*) * CAST(0.000615 AS DOUBLE), 9) AS cost FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ROLLUP (k % 3, event_type)", linked=False)
def cost_rollup(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.get_json_object("props", "$.k").cast("long") % 3).alias("tier"))
    return e.rollup("tier", "event_type").agg(F.count("*").alias("calls")).select("event_type", "tier", "calls", F.round(F.col("calls") * 0.000615, 9).alias("cost"))


@query("SELECT o_orderpriority AS method, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1", linked=False)
def summary_pivot(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("method")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return d.select("method", *[F.coalesce(x, F.lit(0)).cast("long").alias(x.lower()) for x in ("F", "O", "P")])


@query("SELECT p.entity_id, seg FROM periods p JOIN entities e USING (entity_id) WHERE NOT (end_year < birth_year + 3 - 10 OR start_year > death_year - 3 + 10) OR birth_year IS NULL")
def period_life_filter(spark, sf):
    """Periods that do not lie wholly outside the lifetime (here three years shorter at each end) by more than ten years."""
    _, e, p = _all(spark, sf)
    own = years.own_periods(F.array(F.struct("start_year", "end_year")), F.col("birth_year") + 3, F.col("death_year") - 3)
    return p.join(e.select("entity_id", "birth_year", "death_year"), "entity_id").filter(F.size(own) > 0).select("entity_id", "seg")


@query("SELECT e.entity_id, least(min(start_year), any_value(birth_year)) AS lo, greatest(max(end_year), any_value(death_year)) AS hi FROM entities e LEFT JOIN periods p USING (entity_id) GROUP BY 1")
def active_window(spark, sf):
    _, e, p = _all(spark, sf)
    own = p.groupBy("entity_id").agg(F.min("start_year").alias("s"), F.max("end_year").alias("t"))
    return e.join(own, "entity_id", "left").select("entity_id", F.least("s", "birth_year").alias("lo"), F.greatest("t", "death_year").alias("hi"))


@query("SELECT event_id, md5(event_type || ':' || props) AS req, CAST(row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) - 1 AS INT) AS occ FROM events", linked=False)
def cache_occurrence(spark, sf):
    w = Window.partitionBy("event_type", "props").orderBy("event_id")
    req = F.md5(F.concat_ws(":", "event_type", "props").cast("binary"))
    return table(spark, sf, "events").select("event_id", req.alias("req"), (F.row_number().over(w) - 1).alias("occ"))


@query("SELECT s, count(DISTINCT entity_id) AS n FROM (SELECT entity_id, source AS s FROM entities EXCEPT SELECT gold_id, book FROM mentions WHERE year = 1998) GROUP BY s")
def set_difference(spark, sf):
    """Entities of each source that no mention of 1998 means."""
    m, e, _ = _all(spark, sf)
    d = e.select("entity_id", F.col("source").alias("s")).subtract(m.filter("year = 1998").select("gold_id", "book"))
    return d.groupBy("s").agg(F.count_distinct("entity_id").alias("n"))


@query("SELECT source, CAST(count(DISTINCT category) > 1 AS BOOLEAN) AS varies, avg(CASE WHEN birth_year IS NOT NULL THEN 1.0 ELSE 0.0 END) AS covered FROM entities GROUP BY source")
def field_coverage(spark, sf):
    e = fx.entities(spark, sf)
    return e.groupBy("source").agg((F.count_distinct("category") > 1).alias("varies"), F.avg(F.col("birth_year").isNotNull().cast("double")).alias("covered"))


@query("WITH c AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT item_id, count(DISTINCT doc_id) AS n FROM c GROUP BY item_id", linked=False)
def leak_containment(spark, sf):
    """Documents that hold an item verbatim."""
    d = candidates.containing(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item")))
    return d.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n"))


@query("SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS occ FROM events", linked=False)
def occurrence_stream(spark, sf):
    """The place of each event among those of its type, by a stream over the table with a count for each type as its state."""
    stream = streams.occurrences(streams.read_events(spark, sf, "events.parquet"), ["event_type"], "event_id")
    return streams.collected(stream, uuid.uuid4().hex).select("event_id", "event_type", "occ")
