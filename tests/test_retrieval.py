"""Containment, vectors, trees and lists against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from nomena.operators import grams, lexical, storage, trie, vectors


def test_contained_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("aabbbc市") for _ in range(n))
    hays = [word(rng.randint(0, 30)) for _ in range(150)] + ["aaaa", "", None]
    needles = [word(rng.randint(1, 9)) for _ in range(150)] + ["aaaa", "zz", "", None, "aaaa"] + hays[:5]
    asked = spark.createDataFrame([(x,) for x in needles], "needle string")
    held = spark.createDataFrame([(x,) for x in hays], "hay string")
    want = sorted({(n, h) for n in needles if n for h in hays if h is not None and n in h})
    assert sorted(map(tuple, grams.contained(asked, held).collect())) == want
    before, grams.SPLIT = grams.SPLIT, 7  # frequent grams in parts
    try:
        assert sorted(map(tuple, grams.contained(asked, held).collect())) == want
    finally:
        grams.SPLIT = before
    best, _ = grams.rarest_grams(asked, held)
    for r in best.collect():
        own = [r["needle"][i : i + len(r["g"])] for i in range(len(r["needle"]) - len(r["g"]) + 1)]
        assert r["f"] == min(sum(g in (h or "") for h in set(hays)) for g in own)


def test_lexical_search_with_frequent_terms(spark):
    """Every bound and split, against all documents."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.randint(1, 60)]) for _ in range(rng.randint(0, 80)))) for i in range(200)] + [(200, None), (201, ""), (202, "w59\nw59  w59")]
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(15)] + [(15, "none"), (16, "")]
    own = {d: [w for w in (t or "").replace("\n", " ").split(" ") if w] for d, t in docs}
    mean = max(1, sum(map(len, own.values())) // len(docs))
    df = {w: sum(w in x for x in own.values()) for w in vocabulary}
    weight = lambda w, d: 1000 * own[d].count(w) // (own[d].count(w) + 1 + len(own[d]) // mean) * (len(docs) // df[w]).bit_length()
    index = lexical.LexicalIndex.of(spark.createDataFrame(docs, "doc_id long, text string"))
    before, lexical.SPLIT, lexical.FIRST = (lexical.SPLIT, lexical.FIRST), 9, 1
    try:
        got = {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in index.search(spark.createDataFrame(queries, "query_id long, text string"), 4).collect()}
    finally:
        lexical.SPLIT, lexical.FIRST = before
    want = set()
    for q, t in queries:
        scores = [(-sum(weight(w, d) for w in set(t.split()) if w in own[d]), d) for d in own if set(t.split()) & set(own[d])]
        want |= {(q, d, -s, i) for i, (s, d) in enumerate(sorted(scores)[:4], 1)}
    assert got == want
    before, lexical.BLOCK = lexical.BLOCK, 4  # several passes
    try:
        d, q = spark.createDataFrame([*docs, (None, "w1 w2")], "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
        n = {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in lexical.search_texts(d.filter("doc_id IS NOT NULL"), q, 4).collect()}
        assert n == want and lexical.search_texts(d, q, 4).filter("doc_id IS NULL").isEmpty()
    finally:
        lexical.BLOCK = before


def test_lists_without_the_ranking(spark):
    run = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "query_id long, doc_id long, rank int")
    lists = spark.createDataFrame([(1, 6, 1), (1, 7, 2), (2, 8, 1), (2, 7, 2), (3, 1, 1)], "query_id long, doc_id long, place int")
    assert {tuple(r) for r in lexical.held_to_lists(run, lists).collect()} == {(1, 6, 2), (2, 8, None), (3, 1, None)}


def test_beams(spark):
    names = [("ab",), ("abc",), ("b",), ("a",), ("ccc",)]
    tree = trie.children(spark.createDataFrame(names, "x string").select(F.split("x", "").alias("tokens")))
    assert {r["token"] for r in tree.filter("node = 'a'").collect()} == {"b", ""}
    points = lambda q, node, token: F.when(token == "", 0).when(q.contains(token), 5).otherwise(-1)
    got = trie.beam_search(spark.createDataFrame([("abx",), ("c",), ("",)], "query string"), tree, points, beams=2).collect()
    assert {(r["query"], r["name"], r["score"], r["rank"]) for r in got} == {("abx", "ab", 10, 1), ("abx", "abc", 9, 2), ("c", "ccc", 15, 1), ("c", "a", -1, 2), ("", "a", -1, 1), ("", "b", -1, 2)}


def test_vector_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))[rng.integers(40, size=1500)] + 0.4 * rng.normal(size=(1500, 16))
    x = np.r_[x, np.repeat(x[:1], 300, axis=0)].astype(np.float32)  # one vector 301 times
    d = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    s = np.round(x.astype(float) @ x.astype(float).T, 5)
    np.fill_diagonal(s, -np.inf)
    want = {i: set(np.lexsort((np.arange(len(x)), -s[i]))[:5].tolist()) for i in range(len(x))}
    got: dict = {}
    for r in vectors.nearest_neighbours(d, 5, probes=12, lists=32).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(got[i]) == 5 and i not in got[i] for i in want)
    assert sum(len(got[i] & want[i]) for i in want) / (5 * len(x)) >= 0.9
    hot = want[0]
    assert got[0] == hot and all(got[i] == want[i] for i in range(1500, 1510))


def test_tables_go(spark):
    t = storage.written(spark.range(3))
    assert t.count() == 3 and t._written in storage._LEFT
    storage.removed(t)
    assert t._written not in storage._LEFT
