"""Queries of name forms, contexts, years, tags, answers and scores over columns derived from the driver's tables. Each derived table is written once, in expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, text, years
from ..operators import evaluation, evidence, kb, passes, tokens
from ..sources import datasets
from . import dated
from .dated import BASE, FBASE, MBASE, NORM, STRIP
from .fixtures import table
from .registry import query


class Derived:
    """name: columns as expressions over one table. A pair is (Spark's, DuckDB's) where the two differ."""

    def __init__(self, name: str, source: str, columns: dict[str, str | tuple[str, str]], where: str = "true"):
        pair = {c: x if isinstance(x, tuple) else (x, x) for c, x in columns.items()}
        self.source, self.where, self.columns = source, where, {c: x[0] for c, x in pair.items()}
        self.sql = f"{name} AS (SELECT {', '.join(f'{x[1]} AS {c}' for c, x in pair.items())} FROM {source} WHERE {where})"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).filter(self.where).selectExpr(*[f"{x} AS {c}" for c, x in self.columns.items()])


_T = "CAST({} AS STRING)".format
_KEY = _T("p_partkey % 13")
NAMES = Derived(
    "names",
    "part",
    {
        "id": "p_partkey",
        "s": f"CASE p_partkey % 11 WHEN 0 THEN substr('{text.MARKS}', CAST(1 + p_partkey % 14 AS INT), 1) || p_name || substr('{text.MARKS}', CAST(1 + p_size % 14 AS INT), 1) WHEN 1 THEN ' ' || replace(p_name, ' ', '　　') || ' 〈' || {_KEY} || '〉' WHEN 2 THEN p_name || '(' || p_brand || ')' || p_type || '〈' || {_KEY} || '〉(a)（b）' "
        f"WHEN 3 THEN p_name || '（b）(a)' WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN p_name || ' \"' || p_type || '\"' WHEN 7 THEN '〈' || {_KEY} || '〉' || p_name || '〈3b〉' WHEN 8 THEN '　' || p_brand || '　' WHEN 9 THEN 'a(b(' || p_name || ')d)e' ELSE upper(p_name) || '〈12〉(' || p_type || ')' END",
    },
)


@query(
    f"WITH {NAMES.sql} SELECT id, {NORM('s')} AS norm, {BASE('s')} AS base, {MBASE('s')} AS mention, {FBASE('s')} AS family, translate(coalesce(s, ''), ' 　', '') AS squeezed, translate({STRIP('lower(coalesce(s, ' + chr(39) * 2 + '))')}, '''\"', '') AS surface, "
    "coalesce(TRY_CAST(regexp_extract(coalesce(s, ''), '〈(\\d+)', 1) AS INT), 999) AS number, nullif(regexp_extract(coalesce(s, ''), '〈(\\d+)〉', 1), '') AS generation FROM names",
    linked=False,
)
def name_forms(spark, sf):
    """Marks, brackets, blanks and generations of all parts' names."""
    d = NAMES.frame(spark, sf)
    return d.select("id", text.normalize_name("s").alias("norm"), text.base_name("s").alias("base"), text.mention_base("s").alias("mention"), text.family_base("s").alias("family"), text.squeeze("s").alias("squeezed"), text.surface_key("s").alias("surface"), text.generation_number("s").alias("number"), text.generation("s").alias("generation"))


_LANG = "left(lower(coalesce(lang, '')), 2)"
_TRIMMED = "trim(trim(regexp_replace(CASE WHEN l = 'sa' THEN coalesce(s, '') ELSE lower(coalesce(s, '')) END, '\\s+', ' ', 'g')), '.,;:!?''\"()[]{}«»')"
WORDS = Derived("generic", "documents", {"id": "doc_id", "s": "CASE doc_id % 4 WHEN 0 THEN '«' || left(text, 300) || '» ' WHEN 1 THEN left(text, 200) || ' Straße [Köln]' WHEN 2 THEN left(text, 100) || '..' ELSE left(text, 60) END", "lang": "CASE doc_id % 9 WHEN 0 THEN 'fi' WHEN 1 THEN 'sa' WHEN 2 THEN 'sv-SE' WHEN 3 THEN NULL ELSE upper(lang) END"})


@query(f"WITH {WORDS.sql}, g AS (SELECT id, s, {_LANG} AS l FROM generic), t AS (SELECT id, l, {_TRIMMED} AS t FROM g) SELECT id, CASE WHEN l IN ('fi', 'sa') THEN t ELSE strip_accents(CASE WHEN l = 'de' THEN replace(t, 'ß', 'ss') ELSE t END) END AS norm FROM t", linked=False)
def name_forms_generic(spark, sf):
    """Openings of all documents as names in languages with an alphabet: ends stripped once, folding by decomposition, by language. (These are names: 60 to 300 characters; normalize_generic has whole texts.)"""
    return WORDS.frame(spark, sf).select("id", text.normalize_generic("s", "lang").alias("norm"))


CONTEXTS = Derived(
    "contexts",
    "conversations",
    {
        "id": "conv_id",
        "turn": "turn",
        "l": "CASE turn % 6 WHEN 0 THEN text || ' [年:' || " + _T("1700 + conv_id % 200") + " || '|書:X] ' WHEN 1 THEN text || '[年:1800|書:X]' WHEN 2 THEN text || '  [年:?|書:]' WHEN 3 THEN text WHEN 4 THEN '[年:1] ' || text ELSE text || ' [年:1] [年:2]  ' END",
        "r": "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE text END",
    },
)


@query(f"WITH {CONTEXTS.sql}, c AS (SELECT id, turn, coalesce(l, '') AS l, coalesce(r, '') AS r FROM contexts), t AS (SELECT *, regexp_extract(l, '\\s*\\[年:[^\\]]*\\]\\s*$') AS t FROM c) SELECT id, turn, right(left(l, length(l) - length(t)), 64) || t AS l, left(r, 64) AS r FROM t", linked=False)
def context_windows(spark, sf):
    """Contexts of all turns cut to 64 characters, with and without a year token, with any white space around it."""
    left, right = text.window_context(F.col("l"), F.col("r"), 64)
    return CONTEXTS.frame(spark, sf).select("id", "turn", left.alias("l"), right.alias("r"))


LIVES = Derived(
    "lives",
    "orders",
    {
        "id": "o_orderkey",
        "birth": "CAST(CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1700 + o_orderkey % 90 END AS INT)",
        "death": "CAST(CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1790 END ELSE 1760 + o_orderkey % 60 END AS INT)",
        "s": "CAST(CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1680 + o_custkey % 160 END AS INT)",
        "e": "CAST(CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1690 + o_custkey % 170 END AS INT)",
    },
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
    d = LIVES.frame(spark, sf).withColumn("ps", F.array(F.struct(F.col("s").alias("start_year"), F.col("e").alias("end_year"))))
    w = years.active_window(F.col("ps"), F.col("birth"), F.col("death"))
    return d.select("id", (F.size(years.own_periods(F.col("ps"), F.col("birth"), F.col("death"))) > 0).alias("own"), w["low"].alias("low"), w["high"].alias("high"), years.span(F.col("birth"), F.col("death")).alias("span"))


_A, _Z = _T("1700 + o_orderkey % 199"), _T("1790 + o_custkey % 160")
TOLD = Derived(
    "told",
    "orders",
    {
        "id": "o_orderkey",
        "s": f"CASE o_orderkey % 13 WHEN 0 THEN 'painter (b. ' || {_A} || '-' || {_Z} || ')' WHEN 1 THEN '(' || {_A} || '–)' WHEN 2 THEN '(B.' || {_A} || ' - ' || {_Z} || ') x (1900)' WHEN 3 THEN 'play ( ' || {_A} || ' )' WHEN 4 THEN 'a ' || {_T('1 + o_custkey % 20')} || 'th Century poet' WHEN 5 THEN 'fl ' || {_A} WHEN 6 THEN 'Fl. 98 and ' || {_Z} WHEN 7 THEN 'in ' || {_A} || ', then ' || {_Z} "
        f"WHEN 8 THEN 'in 2044' WHEN 9 THEN NULL WHEN 10 THEN 'no year 12' WHEN 11 THEN {_A} || '-06-26' ELSE 'NA' END",
    },
)


@query(
    f"WITH {TOLD.sql}, t AS (SELECT id, coalesce(s, '') AS s FROM told) SELECT id, CASE WHEN regexp_matches(s, '(?i)\\((?:b\\.?\\s*)?(\\d{{3,4}})\\s*[–-]\\s*(\\d{{3,4}})?\\)') THEN CASE WHEN regexp_extract(s, '(?i)\\((?:b\\.?\\s*)?(\\d{{3,4}})\\s*[–-]\\s*(\\d{{3,4}})?\\)', 2) <> '' "
    "THEN regexp_replace(regexp_extract(s, '(?i)\\((?:b\\.?\\s*)?(\\d{3,4})\\s*[–-]\\s*(\\d{3,4})?\\)'), '(?i)\\((?:b\\.?\\s*)?(\\d{3,4})\\s*[–-]\\s*(\\d{3,4})\\)', '\\1–\\2') ELSE 'b. ' || regexp_extract(s, '(?i)\\((?:b\\.?\\s*)?(\\d{3,4})', 1) END "
    "WHEN regexp_matches(s, '\\(\\s*\\d{3,4}\\s*\\)') THEN regexp_extract(s, '\\(\\s*(\\d{3,4})\\s*\\)', 1) WHEN regexp_matches(s, '(?i)\\b\\d{1,2}(?:st|nd|rd|th)\\s+century\\b') THEN regexp_extract(s, '(?i)\\b\\d{1,2}(?:st|nd|rd|th)\\s+century\\b') "
    "WHEN regexp_matches(s, '(?i)\\bfl\\.?\\s*\\d{3,4}\\b') THEN 'fl. ' || regexp_extract(s, '(?i)\\bfl\\.?\\s*(\\d{3,4})\\b', 1) ELSE regexp_extract(s, '\\b(1[0-9]{3}|20[0-2][0-9])\\b', 1) END AS span, TRY_CAST(regexp_extract(s, '\\b(1[0-9]{3}|20[0-2][0-9])\\b', 1) AS INT) AS year FROM t",
    linked=False,
)
def told_years(spark, sf):
    """Spans that descriptions tell, and the year of an anchoring document's date."""
    return TOLD.frame(spark, sf).select("id", years.described_span(F.col("s")).alias("span"), years.document_year(F.lit(None).cast("int"), F.lit("newseye"), F.col("s")).alias("year"))


@query()
def difflib_candidates(spark, sf):
    """Of all asked surfaces, the nearest entities by the ratio of matching characters between surface and bare part name; tests hold the similarity join against all pairs."""
    asked = dated.mentions(spark, sf).select("surface", F.lit(None).cast("int").alias("year")).distinct()  # the year plays no part
    bare = dated.entities(spark, sf).withColumns({"title": F.substring_index("reading", " ", 2), "aliases": F.lit(None).cast("array<string>"), "periods": F.lit(None).cast(kb.PERIODS), "language": F.lit("en")})
    return kb.candidate_list(kb.KnowledgeBase.of(bare), asked, "fuzzy", 10).select("surface", "entity_id", "rank")


@query(dated._POOL + ", nm AS (SELECT surface, year, entity_id, row_number() OVER (PARTITION BY surface, year ORDER BY pos) AS place FROM kk JOIN (SELECT entity_id, pos, " + MBASE("title") + " AS q FROM e) ON q = b), u AS (SELECT surface, year, entity_id, route, 0 AS turn, rank AS place FROM ranked WHERE rank <= 30 UNION ALL SELECT surface, year, entity_id, 1, 1, place FROM r1 UNION ALL SELECT surface, year, entity_id, 3, 2, place FROM nm WHERE place <= 30), f AS (SELECT *, row_number() OVER (PARTITION BY surface, year, entity_id ORDER BY turn, place) AS f FROM u) SELECT * FROM (SELECT surface, year, entity_id, CAST(route AS INT) AS route, CAST(row_number() OVER (PARTITION BY surface, year ORDER BY turn, place) AS INT) AS rank FROM f WHERE f = 1) WHERE rank <= 30", linked=False)
def candidate_union(spark, sf):
    """Routes one after another (all three gathered, surface, base name), each entity once, cut at 30."""
    base, asked = kb.KnowledgeBase.of(dated.entities(spark, sf)), dated._asked(spark, sf)
    return kb.union(base, asked, ["gather", "surface", "name"], 30).select("surface", "year", "entity_id", "route", "rank")


VARIANTS = Derived(
    "v",
    "part",
    {
        "id": "p_partkey",
        "title": "p_name",
        "aliases": ("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE array(upper(p_name), p_type, p_brand, lower(p_type) || 's', 'nara', replace(p_name, ' ', '')) END", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE [upper(p_name), p_type, p_brand, lower(p_type) || 's', 'nara', replace(p_name, ' ', '')] END"),
        "context": "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'tatra ' || lower(p_type) || ' uvAca nara' WHEN 2 THEN lower(p_brand) || ' ' || p_type || 's ' || replace(p_name, ' ', '') ELSE p_name || 'x' END",
    },
)


@query(
    f"WITH {VARIANTS.sql}, o AS (SELECT id, context AS ctx, list_filter(aliases, lambda a: lower(trim(a)) <> lower(title)) AS names FROM v), "
    "h AS (SELECT *, list_filter(names, lambda a: length(a) >= 5 AND list_contains(string_split(lower(ctx), ' '), lower(a)))[1:8] AS hits FROM o) SELECT id, CASE WHEN ctx <> '' AND len(hits) > 0 THEN array_to_string(hits, ',') END AS in_context, CASE WHEN ctx = '' AND len(names) > 0 THEN array_to_string(names[1:8], ',') END AS known_as FROM h",
    linked=False,
)
def evidence_variants(spark, sf):
    """Name variants that the context utters as whole tokens, or the variants where there is no context."""
    d = evidence.collapse_clusters(VARIANTS.frame(spark, sf))
    return d.select("id", F.array_join("names_in_context", ",").alias("in_context"), F.array_join("also_known_as", ",").alias("known_as"))


MARKED = Derived(
    "marked",
    "orders",
    {
        "id": "o_orderkey",
        "fine": "CASE o_orderkey % 5 WHEN 0 THEN 'loc.adm.town' WHEN 1 THEN NULL WHEN 2 THEN 'x.y' WHEN 3 THEN ' ' ELSE '' END",
        "coarse": "CASE o_custkey % 5 WHEN 0 THEN 'LOC' WHEN 1 THEN 'pers' WHEN 2 THEN NULL WHEN 3 THEN 'Zzz' ELSE 'org' END",
        "year": "CAST(CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1700 + o_custkey % 99 ELSE 0 END AS INT)",
        "dataset": "CASE o_custkey % 4 WHEN 0 THEN 'hipe2020' WHEN 1 THEN 'ajmc' WHEN 2 THEN NULL ELSE 'newseye' END",
        "date": "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS STRING) WHEN 1 THEN 'NA' WHEN 2 THEN NULL ELSE '1881' END",
    },
)


@query(
    f"WITH {MARKED.sql}, w AS (SELECT *, trim(coalesce(fine, '')) AS f, lower(coalesce(coarse, '')) AS c, coalesce(year, CASE WHEN dataset IN ('hipe2020', 'newseye', 'sonar', 'topres19th') THEN TRY_CAST(regexp_extract(coalesce(date, ''), '\\b(1[0-9]{{3}}|20[0-2][0-9])\\b', 1) AS INT) END) AS y FROM marked), "
    "p AS (SELECT *, CASE WHEN f = 'loc.adm.town' THEN 'a TOWN or CITY' WHEN f <> '' THEN f WHEN c = 'pers' THEN 'a PERSON' WHEN c = 'org' THEN 'an ORGANISATION' WHEN c = 'loc' THEN 'a PLACE' ELSE c END AS t FROM w) "
    f"SELECT id, concat_ws(chr(10), CASE WHEN t <> '' THEN '{evidence.ASKED_TYPE[0]}' || t || '{evidence.ASKED_TYPE[1]}' END, CASE WHEN dataset IN ('hipe2020', 'newseye', 'sonar', 'topres19th') AND y <> 0 THEN '{evidence.ASKED_YEAR[0]}' || y || '{evidence.ASKED_YEAR[1]}' END) AS lines FROM p",
    linked=False,
)
def evidence_query_lines(spark, sf):
    d = MARKED.frame(spark, sf)
    return d.select("id", evidence.query_lines(*[F.col(c) for c in ("fine", "coarse", "year", "dataset", "date")], True).alias("lines"))


LABELS = Derived("tagged_tokens", "events", {"doc": "user_id", "i": "event_id", "label": "CASE WHEN event_id % 4 = 0 THEN 'B-' WHEN event_id % 11 = 0 THEN 'O-' ELSE 'I-' END || CASE event_id % 3 WHEN 0 THEN 'pers' ELSE 'loc' END"})
_RUNS = f"WITH {LABELS.sql}, o AS (SELECT *, sum(CASE WHEN label LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS span FROM tagged_tokens), t AS (SELECT *, first_value(substr(label, 3)) OVER (PARTITION BY doc, span ORDER BY i) AS type FROM o WHERE span > 0), b AS (SELECT *, max(CASE WHEN label LIKE 'B-%' OR {{on}} THEN 0 ELSE 1 END) OVER (PARTITION BY doc, span ORDER BY i) AS broken FROM t) SELECT doc, CAST(span AS BIGINT) AS span, any_value(type) AS type, min(i) AS first, max(i) AS last, count(*) AS n FROM b WHERE broken = 0 GROUP BY doc, span"


@query(_RUNS.format(on="label = 'I-' || type"), linked=False)
def spans_strict(spark, sf):
    """Two runs for B-x B-x; a run ends at an I- label of another type."""
    return tokens.spans(LABELS.frame(spark, sf), ["doc"], ["i"], strict=True)


@query(_RUNS.format(on="label LIKE 'I-%'"), linked=False)
def spans_loose(spark, sf):
    """As spans_strict, but any I- label goes on."""
    return tokens.spans(LABELS.frame(spark, sf), ["doc"], ["i"], strict=False)


TAGS = Derived(
    "tagged",
    "lineitem",
    {
        "sample_key": _T("l_orderkey") + " || '-' || " + _T("l_linenumber") + " || '-' || " + _T("l_partkey") + " || '-' || " + _T("l_suppkey"),
        "mention": "CASE l_orderkey % 19 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE l_returnflag || l_linestatus || " + _T("l_partkey % 3000") + " END",
        "label_id": "CAST(CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE l_suppkey % 3 END AS INT)",
        "tags": ("CASE l_linenumber % 5 WHEN 0 THEN array('daime') WHEN 1 THEN NULL WHEN 2 THEN array('multi') WHEN 3 THEN array('multi', 'x') ELSE CAST(array() AS array<string>) END", "CASE l_linenumber % 5 WHEN 0 THEN ['daime'] WHEN 1 THEN NULL WHEN 2 THEN ['multi'] WHEN 3 THEN ['multi', 'x'] ELSE CAST([] AS VARCHAR[]) END"),
    },
)
_MULTI = "m AS (SELECT coalesce(mention, '') AS mention FROM tagged GROUP BY 1 HAVING count(DISTINCT label_id) + max(CASE WHEN label_id IS NULL THEN 1 ELSE 0 END) >= 2)"


@query(f"WITH {TAGS.sql}, {_MULTI} SELECT sample_key, array_to_string(nullif(list_sort(list_distinct(list_concat(list_filter(coalesce(tags, []), lambda x: x <> 'multi'), CASE WHEN m.mention IS NOT NULL THEN ['multi'] ELSE [] END))), []), ',') AS tags FROM tagged t LEFT JOIN m ON m.mention = coalesce(t.mention, '')", linked=False)
def tag_ambiguous(spark, sf):
    """The tag is set on ambiguous mentions and taken off others; other tags stay; no tags are null."""
    return passes.tag_ambiguous(TAGS.frame(spark, sf)).select("sample_key", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {TAGS.sql} SELECT t AS tag, count(*) AS n FROM (SELECT unnest(tags) AS t FROM tagged) GROUP BY 1", linked=False)
def tag_counts(spark, sf):
    return datasets.tag_counts(TAGS.frame(spark, sf))


SCORED = Derived("items", "orders", {"sample_idx": "o_orderkey", "label_id": "CAST(CASE WHEN o_orderkey % 29 = 0 THEN -1 ELSE o_custkey % 400 END AS INT)", "type": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderpriority END"})
GUESSES = Derived("preds", "orders", {"sample_idx": "o_orderkey", "pred_id": "CAST(CASE o_orderkey % 6 WHEN 0 THEN -1 WHEN 1 THEN (o_custkey + 50) % 400 WHEN 2 THEN o_orderkey % 401 WHEN 3 THEN -1 ELSE o_custkey % 400 END AS INT)", "pred_title": "CASE o_orderkey % 6 WHEN 0 THEN 'name　' || " + _T("o_custkey % 50") + " WHEN 3 THEN NULL ELSE 'Z' END"}, "o_orderkey % 17 <> 0")
JUDGES = Derived("judges", "part", {"entity_id": "CAST(p_partkey AS INT)", "title": "'na me' || " + _T("p_partkey % 50"), "canon_id": "CAST(p_partkey % 100 AS INT)"})
_JUDGED = f"""WITH {SCORED.sql}, {GUESSES.sql}, {JUDGES.sql}, j AS (SELECT *, translate(title, ' 　', '') AS t FROM judges), bt AS (SELECT t, min(entity_id) AS i FROM j GROUP BY t),
d AS (SELECT s.*, p.sample_idx IS NOT NULL AS here, translate(coalesce(pred_title, ''), ' 　', '') AS pt, CASE WHEN pred_id = -1 AND pred_title IS NOT NULL THEN coalesce(bt.i, -1) ELSE coalesce(pred_id, -1) END AS p FROM items s LEFT JOIN preds p USING (sample_idx) LEFT JOIN bt ON bt.t = translate(pred_title, ' 　', '')),
r AS (SELECT d.*, coalesce(a.canon_id, p) = coalesce(b.canon_id, label_id) AS same, CASE WHEN p <> -1 THEN coalesce(a.t, '') ELSE pt END AS told, coalesce(b.t, '') AS gold FROM d LEFT JOIN j a ON a.entity_id = p LEFT JOIN j b ON b.entity_id = label_id)
SELECT sample_idx, coalesce(type, '?') AS type, NOT here AS missing, here AND same AS id_ok, here AND told <> '' AND told = gold AS title_ok FROM r"""


@query(_JUDGED, linked=False)
def judged_items(spark, sf):
    """Right by identity and by title; missing predictions, titles that resolve, and -1 against -1."""
    j = JUDGES.frame(spark, sf)
    return evaluation.judged(SCORED.frame(spark, sf), GUESSES.frame(spark, sf), j.select("entity_id", "title"), j.select("entity_id", "canon_id"))


@query(f"SELECT count(*) AS n, count(*) FILTER (missing) AS missing, count(*) FILTER (id_ok) AS id_correct, count(*) FILTER (title_ok) AS title_correct FROM ({_JUDGED})", linked=False)
def judged_totals(spark, sf):
    return evaluation.totals(judged_items(spark, sf))


_ID = _T("event_id % 3 + 1")
SAID = Derived(
    "said",
    "events",
    {
        "id": "event_id",
        "s": f"CASE event_id % 9 WHEN 0 THEN 'so {{\"entity_id\": ' || {_ID} || ', \"confidence\": 0.9}}' WHEN 1 THEN 'a {{\"x\": {{\"entity_id\": ' || {_ID} || '}}}} b' WHEN 2 THEN 'bad {{ \"entity_id\": ' || {_ID} || ' }} and }} more' WHEN 3 THEN 'entity_id = ' || {_ID} WHEN 4 THEN '\"entity_id\" : ' || {_ID} || ',' WHEN 5 THEN 'nothing in ' || props WHEN 6 THEN NULL WHEN 7 THEN '{{\"entity_id\": 99}}' ELSE '{{\"entity_id\": null}}' END",
        "named": "CAST(event_id % 3 + 1 AS INT)",
        "lead": "CAST(user_id % 3 + 1 AS INT)",
    },
)


@query(f"WITH {SAID.sql} SELECT id, CASE WHEN id % 9 IN (0, 2, 3, 4) THEN named ELSE lead END AS pick, CASE WHEN id % 9 = 0 THEN '0.9' END AS confidence FROM said", linked=False)
def answer_picks(spark, sf):
    """Ids that answers name, in whole and broken JSON; an id that is no finalist gives the lead."""
    p = answers.pick(F.col("s"), F.array(F.lit(1), F.lit(2), F.lit(3)), F.col("lead"))
    return SAID.frame(spark, sf).select("id", p["id"].cast("int").alias("pick"), p["confidence"].alias("confidence"))
