"""Queries over small stated rows that reach every branch of an operator: what the driver's tables never hold. The SQL reads the same rows as VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomena.functions import answers, text, years
from nomena.operators import evaluation, evidence, kb, passes, tokens
from nomena.plans.dated import BASE, CUT, FBASE, MBASE, NORM, SP, STRIP  # noqa: F401
from nomena.sources import datasets

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None, linked=False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_literal, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{k}: {_literal(v)}" for k, v in x.items()) + "}"
    return "'" + str(x).replace("'", "''") + "'"


class Rows:
    """Rows with a Spark schema; sql is the same rows as a named query."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        columns = [c.strip().split(" ")[0] for c in schema.split(", ")]
        self.sql = f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


NAMES = Rows(
    "names",
    "id int, s string",
    [(i, m + "市川" + m) for i, m in enumerate(text.MARKS)]
    + [(20, None), (21, ""), (22, " 市川　団十郎 〈7〉"), (23, "岩井(半四郎)紫若〈2〉(a)（b）"), (24, "岩井 半四郎（b）(a)"), (25, "A.B,'C' \"D\""), (26, "〈3〉中村〈3b〉"), (27, "☆(1)中村？(12a) 座"), (28, "a(b(c)d)e"), (29, "　x　"), (30, "X〈12〉(y)")],
)


@query(
    f"WITH {NAMES.sql} SELECT id, {NORM('s')} AS norm, {BASE('s')} AS base, {MBASE('s')} AS mention, {FBASE('s')} AS family, translate(coalesce(s, ''), ' 　', '') AS squeezed, translate({STRIP('lower(coalesce(s, ' + chr(39) * 2 + '))')}, '''\"', '') AS surface, "
    "coalesce(TRY_CAST(regexp_extract(coalesce(s, ''), '〈(\\d+)', 1) AS INT), 999) AS number, nullif(regexp_extract(coalesce(s, ''), '〈(\\d+)〉', 1), '') AS generation FROM names",
    linked=False,
)
def name_forms(spark, sf):
    """Marks, brackets, blanks and generations of names, with one row for each mark."""
    d = NAMES.frame(spark)
    return d.select("id", text.normalize_name("s").alias("norm"), text.base_name("s").alias("base"), text.mention_base("s").alias("mention"), text.family_base("s").alias("family"), text.squeeze("s").alias("squeezed"), text.surface_key("s").alias("surface"), text.generation_number("s").alias("number"), text.generation("s").alias("generation"))


GENERIC = Rows("generic", "id int, s string, lang string", [(1, " «Élan»  Vital ", "FR"), (2, "Straße (Köln)", "de-AT"), (3, "Hämeenlinna.", "fi"), (4, "RAma; ", "sa"), (5, "Ångström!?", "sv"), (6, None, None), (7, "[a] {b}", "en"), (8, "..a. .", ""), (9, "\"O'Neil\"", "en")])
_LANG = "left(lower(coalesce(lang, '')), 2)"
_TRIMMED = "trim(trim(regexp_replace(CASE WHEN l = 'sa' THEN coalesce(s, '') ELSE lower(coalesce(s, '')) END, '\\s+', ' ', 'g')), '.,;:!?''\"()[]{}«»')"


@query(f"WITH {GENERIC.sql}, g AS (SELECT id, s, {_LANG} AS l FROM generic), t AS (SELECT id, l, {_TRIMMED} AS t FROM g) SELECT id, CASE WHEN l IN ('fi', 'sa') THEN t ELSE strip_accents(CASE WHEN l = 'de' THEN replace(t, 'ß', 'ss') ELSE t END) END AS norm FROM t", linked=False)
def name_forms_generic(spark, sf):
    """Names in languages with an alphabet: ends stripped once, folding by language."""
    return GENERIC.frame(spark).select("id", text.normalize_generic("s", "lang").alias("norm"))


CONTEXTS = Rows("contexts", "id int, l string, r string, n int", [(1, "abcdef [年:1800|書:X] ", "xyz", 3), (2, "abcdef[年:1800|書:X]", "xyz", 3), (3, "abcdef  [年:?|書:]", "", 2), (4, "abcdef", None, 4), (5, None, "xyz", 4), (6, "[年:1] abc", "x", 2), (7, "ab [年:1] [年:2]  ", "x", 1)])


@query(f"WITH {CONTEXTS.sql}, c AS (SELECT id, coalesce(l, '') AS l, coalesce(r, '') AS r, n FROM contexts), t AS (SELECT *, regexp_extract(l, '\\s*\\[年:[^\\]]*\\]\\s*$') AS t FROM c) SELECT id, right(left(l, length(l) - length(t)), n) || t AS l, left(r, n) AS r FROM t", linked=False)
def context_windows(spark, sf):
    """Contexts cut to n characters with and without a year token, with any white space around it."""
    d, out = CONTEXTS.frame(spark), None
    for n in sorted({r[3] for r in CONTEXTS.rows}):
        left, right = text.window_context(F.col("l"), F.col("r"), n)
        part = d.filter(F.col("n") == n).select("id", left.alias("l"), right.alias("r"))
        out = part if out is None else out.unionByName(part)
    return out


LIVES = Rows(
    "lives",
    "id int, birth int, death int, s int, e int",
    [(1, 1745, 1782, 1766, 1782), (2, 1745, 1782, 1962, 2000), (3, 1745, 1782, 1792, None), (4, 1745, 1782, 1793, None), (5, 1745, 1782, None, 1735), (6, 1745, 1782, 0, 1734), (7, None, None, 5, 9), (8, 1745, None, 1700, 1734), (9, None, 1782, 1793, 1800), (10, 1745, 1782, None, None), (11, 0, 0, 1800, 1810), (12, None, 1782, 0, 0)],
)


@query(
    f"WITH {LIVES.sql}, k AS (SELECT *, nullif(s, 0) AS ks, nullif(e, 0) AS ke, coalesce(birth, -9999) - 10 AS lo, coalesce(death, 9999) + 10 AS hi FROM lives), "
    "o AS (SELECT *, birth IS NULL AND death IS NULL OR NOT coalesce(least(ks, ke) > hi OR greatest(ks, ke) < lo, FALSE) AS own FROM k), "
    "y AS (SELECT *, list_filter([CASE WHEN own THEN ks END, CASE WHEN own THEN ke END, nullif(birth, 0), nullif(death, 0)], lambda x: x IS NOT NULL) AS ys FROM o) "
    "SELECT id, own, list_min(ys) AS low, list_max(ys) AS high, CASE WHEN nullif(birth, 0) IS NULL AND nullif(death, 0) IS NULL THEN '?' ELSE coalesce(CAST(nullif(birth, 0) AS VARCHAR), '?') || '–' || coalesce(CAST(nullif(death, 0) AS VARCHAR), '?') END AS span FROM y",
    linked=False,
)
def life_windows(spark, sf):
    """Dated names that can be a person's (ten years of slack, one-sided ones too), the window of all known years, and the life as shown."""
    d = LIVES.frame(spark).withColumn("ps", F.array(F.struct(F.col("s").alias("start_year"), F.col("e").alias("end_year"))))
    w = years.active_window(F.col("ps"), F.col("birth"), F.col("death"))
    return d.select("id", (F.size(years.own_periods(F.col("ps"), F.col("birth"), F.col("death"))) > 0).alias("own"), w["low"].alias("low"), w["high"].alias("high"), years.span(F.col("birth"), F.col("death")).alias("span"))


TOLD = Rows("told", "id int, s string", [(1, "painter (b. 1813-1869)"), (2, "(1813–)"), (3, "(B.1813 - 1869) x (1900)"), (4, "play ( 1881 )"), (5, "a 16th Century poet"), (6, "fl 1500"), (7, "Fl. 98 and 1701"), (8, "in 1744, then 1800"), (9, "in 2044"), (10, None), (11, "no year 12"), (12, "1900-06-26"), (13, "NA")])


@query(
    f"WITH {TOLD.sql}, t AS (SELECT id, coalesce(s, '') AS s FROM told) SELECT id, CASE WHEN regexp_matches(s, '(?i)\\((?:b\\.?\\s*)?(\\d{{3,4}})\\s*[–-]\\s*(\\d{{3,4}})?\\)') THEN CASE WHEN regexp_extract(s, '(?i)\\((?:b\\.?\\s*)?(\\d{{3,4}})\\s*[–-]\\s*(\\d{{3,4}})?\\)', 2) <> '' "
    "THEN regexp_replace(regexp_extract(s, '(?i)\\((?:b\\.?\\s*)?(\\d{3,4})\\s*[–-]\\s*(\\d{3,4})?\\)'), '(?i)\\((?:b\\.?\\s*)?(\\d{3,4})\\s*[–-]\\s*(\\d{3,4})\\)', '\\1–\\2') ELSE 'b. ' || regexp_extract(s, '(?i)\\((?:b\\.?\\s*)?(\\d{3,4})', 1) END "
    "WHEN regexp_matches(s, '\\(\\s*\\d{3,4}\\s*\\)') THEN regexp_extract(s, '\\(\\s*(\\d{3,4})\\s*\\)', 1) WHEN regexp_matches(s, '(?i)\\b\\d{1,2}(?:st|nd|rd|th)\\s+century\\b') THEN regexp_extract(s, '(?i)\\b\\d{1,2}(?:st|nd|rd|th)\\s+century\\b') "
    "WHEN regexp_matches(s, '(?i)\\bfl\\.?\\s*\\d{3,4}\\b') THEN 'fl. ' || regexp_extract(s, '(?i)\\bfl\\.?\\s*(\\d{3,4})\\b', 1) ELSE regexp_extract(s, '\\b(1[0-9]{3}|20[0-2][0-9])\\b', 1) END AS span, TRY_CAST(regexp_extract(s, '\\b(1[0-9]{3}|20[0-2][0-9])\\b', 1) AS INT) AS year FROM t",
    linked=False,
)
def told_years(spark, sf):
    """Spans that descriptions tell, and the year of an anchoring document's date."""
    return TOLD.frame(spark).select("id", years.described_span(F.col("s")).alias("span"), years.document_year(F.lit(None).cast("int"), F.lit("newseye"), F.col("s")).alias("year"))


_P = lambda name, s, e, daime=None, kind=None, reading=None: {"name": name, "reading": reading, "daime": daime, "start_year": s, "end_year": e, "name_type": kind}
BASE_ROWS = [
    (1, 0, "市川　団十郎〈1〉", "初代", "actor", "1", "だんじゅうろう", 1660, 1704, "ja", None, None, [_P("市川団十郎", 1673, 1704, "1")]),
    (2, 1, "市川団十郎〈2〉", "二代", "actor", "2", "だんじゅうろう", 1688, 1758, "ja", None, None, [_P("市川九蔵", 1697, 1704, "1"), _P("市川団十郎", 1704, 1735, "2"), _P("市川海老蔵", 1735, 1758, "2")]),
    (3, 2, "市川団十郎(歌舞伎 役者)〈7〉", "七代", "actor", "7", "だんじゅうろう", 1791, 1859, "ja", None, None, [_P("市川団十郎", 1800, 1832, "7"), _P("市川海老蔵", 1832, 1859, "5")]),
    (4, 3, "岩井半四郎〈5〉", "五代", "actor", "5", "はんしろう", 1776, 1847, "ja", None, None, [_P("岩井粂三郎", 1787, 1804, "1"), _P("岩井半四郎", 1804, 1832, "5")]),
    (5, 4, "☆岩井紫若", "", "actor", None, None, None, None, "ja", None, None, [_P("岩井紫若", None, 0)]),
    (6, 5, "坂東三津五郎〈1〉", "", "actor", "1", "みつごろう", 1745, 1782, "ja", None, None, [_P("坂東三津五郎", 1766, 1782, "1"), _P("坂東八十助", 1962, 2000, "9")]),
    (7, 6, "中村座", "theatre", "theater", None, None, None, None, "ja", None, ["江戸中村座"], None),
    (8, 7, "市川 団十郎 (a)", "", "actor", "0", None, 1900, 1950, "ja", None, None, []),
]
ASKED = [("市川団十郎", 1710), ("市川団十郎", 1810), ("市川団十郎", None), ("市川海老蔵", 1740), ("岩井半四郎〈4〉", 1800), ("半四郎", 1810), ("岩井紫若☆", 1800), ("三津五郎", 0), ("江戸中村座", 1700), ("無名", 1700), ("市", 1700)]
_FIELDS = [c.strip() for c in "entity_id, pos, title, text, category, daime, reading, birth_year, death_year, language, cluster_id, aliases, periods".split(",")]


def base_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASE_ROWS, kb.ENTITY)


def asked_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "surface string, year int")


_E = "e(entity_id, pos, title, birth_year, death_year) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, (r[0], r[1], r[2], r[7], r[8]))) + ")" for r in BASE_ROWS) + ")"
_N = "p(entity_id, pos, place, name, s, e) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, (r[0], r[1], i, x["name"], x["start_year"], x["end_year"]))) + ")" for r in BASE_ROWS for i, x in enumerate(r[12] or [])) + ")"
_A = "al(entity_id, pos, place, name) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, (r[0], r[1], 100 + i, x))) + ")" for r in BASE_ROWS for i, x in enumerate(r[11] or [])) + ")"
_K = "k(surface, year) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, x)) + ")" for x in ASKED) + ")"
_POOL = f"""WITH {_E}, {_N}, {_A}, {_K},
kk AS (SELECT *, {NORM('surface')} AS n, {MBASE('surface')} AS b FROM k),
tk AS (SELECT entity_id, pos, {NORM('title')} AS key, {FBASE('title')} AS base FROM e),
ak AS (SELECT entity_id, pos, place, key FROM (SELECT entity_id, pos, place, {NORM('name')} AS key FROM p UNION ALL SELECT entity_id, pos, place, {NORM('name')} FROM al) WHERE key <> ''),
r0 AS (SELECT surface, year, entity_id, 0 AS route, row_number() OVER (PARTITION BY surface, year ORDER BY pos, place) AS place FROM kk JOIN ak ON key = n WHERE EXISTS (SELECT 1 FROM p q WHERE q.entity_id = ak.entity_id AND {NORM('q.name')} = n AND q.s <> 0 AND q.e <> 0 AND kk.year BETWEEN q.s AND q.e)),
exact AS (SELECT surface, year, entity_id, 0 AS kind, pos, 0 AS place FROM kk JOIN tk ON key = n UNION ALL SELECT surface, year, entity_id, 1, pos, place FROM kk JOIN ak ON key = n),
near AS (SELECT surface, year, entity_id, 2 AS kind, pos, 0 AS place FROM kk JOIN tk ON contains(key, n) AND key <> n WHERE length(n) >= 2 AND NOT EXISTS (SELECT 1 FROM exact x WHERE x.surface = kk.surface)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY surface, year, entity_id ORDER BY kind, pos, place) AS f FROM (SELECT * FROM exact UNION ALL SELECT * FROM near)),
r1 AS (SELECT surface, year, entity_id, 1 AS route, row_number() OVER (PARTITION BY surface, year ORDER BY kind, pos, place) AS place FROM firsts WHERE f = 1),
fam AS (SELECT surface, year, entity_id, pos FROM kk JOIN tk ON base = b),
fam2 AS (SELECT kk.surface, kk.year, t.entity_id, t.pos FROM kk JOIN tk t ON t.base = (SELECT arg_min(base, pos) FROM tk z WHERE {NORM('z.base')} = {NORM('kk.b')}) WHERE NOT EXISTS (SELECT 1 FROM fam WHERE fam.surface = kk.surface AND fam.year IS NOT DISTINCT FROM kk.year)),
r2 AS (SELECT surface, year, entity_id, 2 AS route, row_number() OVER (PARTITION BY surface, year ORDER BY pos) AS place FROM (SELECT * FROM fam UNION ALL SELECT * FROM fam2)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY surface, year, entity_id ORDER BY route, place) AS f FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)) WHERE f = 1),
scored AS (SELECT pool.*, CASE WHEN year IS NULL THEN 0 WHEN EXISTS (SELECT 1 FROM p WHERE p.entity_id = pool.entity_id AND p.s <> 0 AND p.e <> 0 AND year BETWEEN p.s AND p.e) THEN 3 WHEN year BETWEEN nullif(birth_year, 0) AND nullif(death_year, 0) THEN 2
  WHEN coalesce(year NOT BETWEEN nullif(birth_year, 0) - 5 AND nullif(death_year, 0) + 5, FALSE) THEN -1 WHEN EXISTS (SELECT 1 FROM p WHERE p.entity_id = pool.entity_id AND (coalesce(p.s, 0) <> 0 OR coalesce(p.e, 0) <> 0)) THEN 1 ELSE 0 END AS score FROM pool JOIN e USING (entity_id))"""


@query(_POOL + " SELECT surface, year, entity_id, CAST(route AS INT) AS route, CAST(row_number() OVER (PARTITION BY surface, year ORDER BY score DESC, route, place) AS INT) AS rank FROM scored", linked=False)
def gather_names(spark, sf):
    """All three routes with normal forms: dated names in the year, titles and names at any year, fallback to titles that hold the surface, family; re-ranked by year."""
    return kb.gather(kb.KnowledgeBase.of(base_frame(spark)), asked_frame(spark)).select("surface", "year", "entity_id", "route", "rank")


@query(_POOL + " SELECT surface, year, entity_id, CAST(place AS INT) AS place FROM r1", linked=False)
def surface_search(spark, sf):
    return kb.surface_search(kb.KnowledgeBase.of(base_frame(spark)), asked_frame(spark)).select("surface", "year", "entity_id", "place")


@query(_POOL + " SELECT surface, year, entity_id, CAST(place AS INT) AS place FROM r2", linked=False)
def family_search(spark, sf):
    return kb.family(kb.KnowledgeBase.of(base_frame(spark)), asked_frame(spark)).select("surface", "year", "entity_id", "place")


@query(f"WITH {_E}, {_K} SELECT surface, year, entity_id, CAST(row_number() OVER (PARTITION BY surface, year ORDER BY pos) AS INT) AS rank FROM k JOIN e ON {MBASE('title')} = {MBASE('surface')}", linked=False)
def name_pool(spark, sf):
    return kb.candidate_list(kb.KnowledgeBase.of(base_frame(spark)), asked_frame(spark), "name", 0).select("surface", "year", "entity_id", "rank")


@query(f"WITH {_E}, {_K} SELECT surface, year, entity_id, CAST(row_number() OVER (PARTITION BY surface, year ORDER BY pos) AS INT) AS rank FROM k JOIN e ON {BASE('title')} = {BASE('surface')}", linked=False)
def basename_pool(spark, sf):
    return kb.candidate_list(kb.KnowledgeBase.of(base_frame(spark)), asked_frame(spark), "basename", 0).select("surface", "year", "entity_id", "rank")


@query()
def difflib_candidates(spark, sf):
    """Nearest keys by the ratio of matching characters; tests hold it against all pairs."""
    return kb.candidate_list(kb.KnowledgeBase.of(base_frame(spark)), asked_frame(spark), "fuzzy", 10).select("surface", "year", "entity_id", "rank")


@query()
def candidate_union(spark, sf):
    """Routes one after another, each entity once, cut at 30."""
    return kb.candidate_list(kb.KnowledgeBase.of(base_frame(spark)), asked_frame(spark), "union", 30).select("surface", "year", "entity_id", "route", "rank")


_HELD = "WITH " + _E + ", " + _N + ", y(year) AS (VALUES (1700), (1704), (1740), (1810)), h AS (SELECT entity_id, year, arg_min(name, place) AS name FROM p, y WHERE s <> 0 AND p.e <> 0 AND year BETWEEN s AND p.e GROUP BY 1, 2), l AS (SELECT entity_id, string_agg(name || '(' || coalesce(CAST(s AS VARCHAR), 'None') || '-' || coalesce(CAST(p.e AS VARCHAR), 'None') || ')', ', ' ORDER BY place) AS names FROM p WHERE coalesce(s, 0) <> 0 OR coalesce(p.e, 0) <> 0 GROUP BY 1)"


@query(_HELD + " SELECT e.entity_id, y.year, left(concat_ws('; ', 'birth_year=' || birth_year, 'death_year=' || death_year, 'name_at_mention_year=' || h.name, 'name_periods=' || names), 60) AS sheet FROM e CROSS JOIN y LEFT JOIN h ON h.entity_id = e.entity_id AND h.year = y.year LEFT JOIN l ON l.entity_id = e.entity_id", linked=False)
def evidence_sheets(spark, sf):
    """Sheets of dated names at several years, in the fixed order of fields, cut at 60 characters."""
    d = evidence.from_entities(base_frame(spark)).withColumn("year", F.explode(F.array(*[F.lit(y) for y in (1700, 1704, 1740, 1810)])))
    d = evidence.organized(d, "dated", False)
    return d.select("entity_id", "year", evidence.render_sheet(d, 60).alias("sheet"))


VARIANTS = [(1, "arjuna", ["Arjuna", "phalguna", "kirItI", "nara", "savyasAcI"], "tatra phalguna uvAca savyasaci"), (2, "kfzRa", ["kfzRa", "govinda"], ""), (3, "x", None, "y"), (4, "rAma", ["rAmabhadra"], "rAmabhadraH")]


@query(
    "WITH v(id, title, aliases, ctx) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in VARIANTS) + "), o AS (SELECT id, ctx, list_filter(aliases, lambda a: lower(trim(a)) <> lower(title)) AS names FROM v), "
    "h AS (SELECT *, list_filter(names, lambda a: length(a) >= 5 AND list_contains(string_split(lower(ctx), ' '), lower(a)))[1:8] AS hits FROM o) SELECT id, CASE WHEN ctx <> '' AND len(hits) > 0 THEN array_to_string(hits, ',') END AS in_context, CASE WHEN ctx = '' AND len(names) > 0 THEN array_to_string(names[1:8], ',') END AS known_as FROM h",
    linked=False,
)
def evidence_variants(spark, sf):
    """Name variants that the context utters as whole tokens, or the variants where there is no context."""
    d = evidence.collapse_clusters(spark.createDataFrame(VARIANTS, "id int, title string, aliases array<string>, context string"))
    return d.select("id", F.array_join("names_in_context", ",").alias("in_context"), F.array_join("also_known_as", ",").alias("known_as"))


MARKED = Rows("marked", "id int, fine string, coarse string, year int, dataset string, date string", [(1, "loc.adm.town", "LOC", None, "hipe2020", "1900-06-26"), (2, None, "pers", None, "ajmc", "1881"), (3, "x.y", None, 1774, None, None), (4, "", "", None, "newseye", "NA"), (5, None, "Zzz", 1801, "sonar", None), (6, " ", "org", 0, "newseye", "1850")])


@query(
    f"WITH {MARKED.sql}, w AS (SELECT *, trim(coalesce(fine, '')) AS f, lower(coalesce(coarse, '')) AS c, coalesce(year, CASE WHEN dataset IN ('hipe2020', 'newseye', 'sonar', 'topres19th') THEN TRY_CAST(regexp_extract(coalesce(date, ''), '\\b(1[0-9]{{3}}|20[0-2][0-9])\\b', 1) AS INT) END) AS y FROM marked), "
    "p AS (SELECT *, CASE WHEN f = 'loc.adm.town' THEN 'a TOWN or CITY' WHEN f <> '' THEN f WHEN c = 'pers' THEN 'a PERSON' WHEN c = 'org' THEN 'an ORGANISATION' ELSE c END AS t FROM w) "
    "SELECT id, concat_ws(chr(10), CASE WHEN t <> '' THEN 'Annotators marked the mention as ' || t || '; a record of that kind fits better.' END, CASE WHEN dataset IN ('hipe2020', 'newseye', 'sonar', 'topres19th') AND y <> 0 THEN 'Its document came out in ' || y || '; the `dates` of the right record allow that.' END) AS lines FROM p",
    linked=False,
)
def evidence_query_lines(spark, sf):
    d = MARKED.frame(spark)
    return d.select("id", evidence.query_lines(*[F.col(c) for c in ("fine", "coarse", "year", "dataset", "date")], True).alias("lines"))


LABELS = Rows("tagged_tokens", "doc int, i int, label string", [(1, i, x) for i, x in enumerate(["B-pers", "I-pers", "B-pers", "I-loc", "I-pers", "O", "I-loc", "B-loc"])] + [(2, i, x) for i, x in enumerate(["I-x", "B-x", "B-x", "I-x", "O"])])
_RUNS = f"WITH {LABELS.sql}, o AS (SELECT *, sum(CASE WHEN label LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS span FROM tagged_tokens), t AS (SELECT *, first_value(substr(label, 3)) OVER (PARTITION BY doc, span ORDER BY i) AS type FROM o WHERE span > 0), b AS (SELECT *, max(CASE WHEN label LIKE 'B-%' OR {{on}} THEN 0 ELSE 1 END) OVER (PARTITION BY doc, span ORDER BY i) AS broken FROM t) SELECT doc, CAST(span AS BIGINT) AS span, any_value(type) AS type, min(i) AS first, max(i) AS last, count(*) AS n FROM b WHERE broken = 0 GROUP BY doc, span"


@query(_RUNS.format(on="label = 'I-' || type"), linked=False)
def spans_strict(spark, sf):
    """Two runs for B-x B-x; a run ends at an I- label of another type."""
    return tokens.spans(LABELS.frame(spark), ["doc"], ["i"], strict=True)


@query(_RUNS.format(on="label LIKE 'I-%'"), linked=False)
def spans_loose(spark, sf):
    """As spans_strict, but any I- label goes on."""
    return tokens.spans(LABELS.frame(spark), ["doc"], ["i"], strict=False)


TAGS = Rows("tagged", "sample_idx bigint, mention string, label_id int, tags array<string>", [(1, "a", 1, ["daime"]), (2, "a", 2, None), (3, "b", 1, ["multi"]), (4, "b", 1, ["multi", "x"]), (5, None, 3, []), (6, "", 4, ["z", "multi"])])


@query(f"WITH {TAGS.sql}, m AS (SELECT coalesce(mention, '') AS mention FROM tagged GROUP BY 1 HAVING count(DISTINCT label_id) >= 2) SELECT sample_idx, array_to_string(nullif(list_sort(list_distinct(list_concat(list_filter(coalesce(tags, []), lambda x: x <> 'multi'), CASE WHEN coalesce(mention, '') IN (SELECT mention FROM m) THEN ['multi'] ELSE [] END))), []), ',') AS tags FROM tagged", linked=False)
def tag_ambiguous(spark, sf):
    """The tag is set on ambiguous mentions and taken off others; other tags stay; no tags are null."""
    return passes.tag_ambiguous(TAGS.frame(spark)).select("sample_idx", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {TAGS.sql} SELECT t AS tag, count(*) AS n FROM (SELECT unnest(tags) AS t FROM tagged) GROUP BY 1", linked=False)
def tag_counts(spark, sf):
    return datasets.tag_counts(TAGS.frame(spark))


SCORED = Rows("items", "sample_idx bigint, label_id int, type string", [(0, 1, "a"), (1, 2, "a"), (2, 3, "b"), (3, -1, "b"), (4, 4, None), (5, 9, "b"), (6, 5, "b")])
GUESSES = Rows("preds", "sample_idx bigint, pred_id int, pred_title string", [(0, 2, "x"), (1, -1, "B C"), (2, 1, "A"), (3, -1, None), (5, 9, None), (6, -1, "nobody")])
JUDGES = Rows("judges", "entity_id int, title string, canon_id int", [(1, "A", 1), (2, "B　C", 1), (3, "A", 3), (4, "D", 4), (5, "BC", 5)])
_JUDGED = f"""WITH {SCORED.sql}, {GUESSES.sql}, {JUDGES.sql}, j AS (SELECT *, translate(title, ' 　', '') AS t FROM judges), bt AS (SELECT t, min(entity_id) AS i FROM j GROUP BY t),
d AS (SELECT s.*, p.sample_idx IS NOT NULL AS here, translate(coalesce(pred_title, ''), ' 　', '') AS pt, CASE WHEN pred_id = -1 AND pred_title IS NOT NULL THEN coalesce((SELECT i FROM bt WHERE bt.t = translate(pred_title, ' 　', '')), -1) ELSE coalesce(pred_id, -1) END AS p FROM items s LEFT JOIN preds p USING (sample_idx)),
r AS (SELECT d.*, coalesce((SELECT canon_id FROM j WHERE entity_id = p), p) = coalesce((SELECT canon_id FROM j WHERE entity_id = label_id), label_id) AS same, CASE WHEN p <> -1 THEN coalesce((SELECT t FROM j WHERE entity_id = p), '') ELSE pt END AS told, coalesce((SELECT t FROM j WHERE entity_id = label_id), '') AS gold FROM d)
SELECT sample_idx, coalesce(type, '?') AS type, NOT here AS missing, here AND same AS id_ok, here AND told <> '' AND told = gold AS title_ok FROM r"""


@query(_JUDGED, linked=False)
def judged_items(spark, sf):
    """Right by identity and by title; missing predictions, titles that resolve, and -1 against -1."""
    j = JUDGES.frame(spark)
    return evaluation.judged(SCORED.frame(spark), GUESSES.frame(spark), j.select("entity_id", "title"), j.select("entity_id", "canon_id"))


@query(f"SELECT count(*) AS n, count(*) FILTER (missing) AS missing, count(*) FILTER (id_ok) AS id_correct, count(*) FILTER (title_ok) AS title_correct FROM ({_JUDGED})", linked=False)
def judged_totals(spark, sf):
    return evaluation.totals(judged_items(spark, sf))


SAID = Rows(
    "said",
    "id int, s string, lead int",
    [(1, 'so {"entity_id": 3, "confidence": 0.9}', 1), (2, 'a {"x": {"entity_id": 2}} b', 1), (3, 'bad { "entity_id": 2 } and } more', 1), (4, "entity_id = 3", 1), (5, '"entity_id" : 2,', 1), (6, "nothing", 1), (7, None, 1), (8, '{"entity_id": 99}', 2), (9, '{"entity_id": null}', 3)],
)
WANTED = [(1, 3, "0.9"), (2, 1, None), (3, 2, None), (4, 3, None), (5, 2, None), (6, 1, None), (7, 1, None), (8, 2, None), (9, 3, None)]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in WANTED) + ") t(id, pick, confidence)", linked=False)
def answer_picks(spark, sf):
    """Ids that answers name, in whole and broken JSON; an id that is no finalist gives the lead."""
    p = answers.pick(F.col("s"), F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("lead"))
    return SAID.frame(spark).select("id", p["id"].cast("int").alias("pick"), p["confidence"].alias("confidence"))
