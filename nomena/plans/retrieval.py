"""Queries of the retrieval operators: lexical search, rankings held to lists, constrained generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import lexical, trie, vectors
from . import dated
from .dated import NORM
from .fixtures import table
from .registry import query

_SEARCHED = """WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda x: x <> '') AS ws FROM documents),
al AS (SELECT count(*) AS n, greatest(1, CAST(sum(len(ws)) AS BIGINT) // count(*)) AS mean FROM s),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM s) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, length(bin(any_value(n) // count(*))) AS idf FROM tf, al GROUP BY term),
post AS (SELECT tf.term, doc_id, df, (1000 * tf // (tf + 1 + length // mean)) * idf AS weight FROM tf JOIN df USING (term), al),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')) AS term FROM benchmark),
run AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT query_id, doc_id, CAST(sum(weight) AS BIGINT) AS score FROM q JOIN post USING (term) GROUP BY 1, 2))"""


def _texts(spark, sf):
    return table(spark, sf, "documents"), table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")


@query(_SEARCHED + " SELECT query_id, doc_id, score, rank FROM run WHERE rank <= 10", linked=False)
def lexical_topk(spark, sf):
    """The ten best documents for each benchmark item by the stated weights."""
    return lexical.search_texts(*_texts(spark, sf), 10)


@query(
    _SEARCHED + ", o AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS place FROM q JOIN df USING (term)), l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS listed FROM o JOIN post USING (term) WHERE place <= 3 GROUP BY 1, 2), "
    "x AS (SELECT l.query_id, l.doc_id, listed, r.rank FROM l LEFT JOIN run r ON r.query_id = l.query_id AND r.doc_id = l.doc_id AND r.rank <= 30 WHERE listed <= 10) SELECT query_id, doc_id, rank AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rank, 2147483647), listed) AS f FROM x) WHERE f = 1",
    linked=False,
)
def run_in_list(spark, sf):
    """A ranking of thirty held to lists of ten, those with most of the item's three rarest terms: the best listed document, else the list's first."""
    docs, items = _texts(spark, sf)
    lists = lexical.search_texts(docs, items, 10, rarest=3).select("query_id", "doc_id", F.col("rank").alias("place"))
    return lexical.held_to_lists(lexical.search_texts(docs, items, 30).select("query_id", "doc_id", "rank"), lists)


def _scored(q: F.Column, node: F.Column, token: F.Column) -> F.Column:
    """A stand-in for a model: a digest of what is known, and more for tokens that the surface has."""
    dice = F.conv(F.left(F.md5(F.concat(q, F.lit("|"), F.replace(node, F.lit(trie.SEP), F.lit("")), F.lit("|"), token).cast("binary")), F.lit(4)), 16, 10).cast("long")
    return dice + F.when((token != trie.END) & q.contains(token), 60_000).otherwise(0)


@query(
    dated._BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", names AS (SELECT DISTINCT regexp_extract_all(x, '.{{1,3}}') AS ts FROM (SELECT {NORM('title')} AS x FROM e UNION SELECT {NORM('name')} FROM p)),
tree AS MATERIALIZED (SELECT DISTINCT array_to_string(ts[1 : i - 1], '') || CASE WHEN i > len(ts) + 1 THEN NULL ELSE '' END AS node, CASE WHEN i > len(ts) THEN '' ELSE ts[i] END AS token, array_to_string(ts[1 : i], '') AS child FROM names, range(1, len(ts) + 2) AS t(i)),
beam AS (SELECT DISTINCT surface AS query, '' AS node, CAST(0 AS BIGINT) AS score, FALSE AS done, 0 AS step FROM k
  UNION ALL SELECT query, node, score, done, step FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node, done) AS r FROM (
    SELECT b.query, CASE WHEN b.done THEN b.node ELSE t.child END AS node, b.score + CASE WHEN b.done THEN 0 ELSE CAST('0x' || left(md5(b.query || '|' || b.node || '|' || t.token), 4) AS BIGINT) + CASE WHEN t.token <> '' AND contains(b.query, t.token) THEN 60000 ELSE 0 END END AS score, b.done OR t.token = '' AS done, b.step + 1 AS step
    FROM beam b LEFT JOIN tree t ON t.node = b.node AND NOT b.done WHERE b.done OR t.node IS NOT NULL)) WHERE r <= 5 AND step <= 9)
SELECT query, node AS name, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS INT) AS rank FROM beam WHERE step = 9 AND done""",
    linked=False,
)
def trie_beams(spark, sf):
    """For each surface that is asked for, five beams over the tree of all names, in tokens of three characters."""
    e = dated.entities(spark, sf)
    names = e.select(text.normalize_name("title").alias("x")).union(e.select(F.explode("periods.name")).select(text.normalize_name("col")))
    tree = trie.children(names.select(F.regexp_extract_all("x", F.lit("(.{1,3})"), F.lit(1)).alias("tokens")))
    return trie.beam_search(dated._asked(spark, sf).select(F.col("surface").alias("query")).distinct(), tree, _scored)


@query(linked=False)
def vector_topk(spark, sf):
    """The ten nearest others of every embedding, by the index; tests and the README have its recall against all pairs."""
    return vectors.nearest_neighbours(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query("SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * v.embedding[i])), 5) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id)) WHERE rank <= 10", linked=False)
def vector_topk_exact(spark, sf):
    """The same by the exact way: all lists probed, and twice as many kept for exact scores as the codes' error asks for."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    index = vectors.VectorIndex.of(v, 10)
    return index.expanded(index.neighbours(10, vectors.LISTS, 64), v, 10)
