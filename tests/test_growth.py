"""What is sorted and shuffled grows with the input, not with its square: rows are counted where they used to multiply."""

import difflib
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nomena.operators import candidates, canon, kb, trie


@pytest.fixture(scope="module")
def base(spark):
    """40 entities of one name, 30 of them with a dated name, and one of another name."""
    rows = [(i, i, f"Ann Lee〈{i}〉", "", "p", str(i), "", 1900, 1950, "ja", None, None, [("Ann Lee", None, None, 1900, 1950, None)] if i < 30 else []) for i in range(40)]
    rows.append((40, 40, "Bo Ek", "", "p", "1", "", 1900, 1950, "ja", None, None, []))
    return kb.KnowledgeBase.of(spark.createDataFrame(rows, kb.ENTITY))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(f"Ann Lee〈{i}〉", 1920) for i in range(50)] + [("Bo Ek", None), (None, 1920)], "surface string, year int")


def counted(monkeypatch, name):
    """Rows that go into the helper, at each call."""
    seen, real = [], getattr(kb, name)
    monkeypatch.setattr(kb, name, lambda d, *a, **b: (seen.append(d.count()), real(d, *a, **b))[1])
    return seen


def test_dated_names_once_a_form(monkeypatch, base, asked):
    seen = counted(monkeypatch, "_ranked")
    found = kb.alias_at_year(base, asked, 30).collect()
    assert seen == [30]
    assert len(found) == 50 * 30 and {r.year for r in found} == {1920}


def test_gather_once_a_form(monkeypatch, base, asked):
    seen, real = [], kb.year_scored
    monkeypatch.setattr(kb, "year_scored", lambda k, pool: (seen.append(pool.count()), real(k, pool))[1])
    found = kb.gather(base, asked).collect()
    assert seen == [31]  # 30 of the first name, one of the other
    assert len(found) == 50 * 30 + 1 and not [r for r in found if r.surface is None]


def test_places_of_bases_once(monkeypatch, base, asked):
    seen = counted(monkeypatch, "top_k")
    found = kb.candidate_list(base, asked, "basename", 0).collect()
    assert seen == [41]
    assert sorted(r["rank"] for r in found if r.surface == "Ann Lee〈7〉") == list(range(1, 41))


def test_all_pairs_by_tiles(spark, monkeypatch, base, asked):
    """Tiles whose edges cut both sides give each pair once, keys that repeat or are null as often as they come."""
    want = sorted((f"Ann Lee〈{i}〉", 1920, e, e + 1) for i in range(50) for e in range(40)) + [("Bo Ek", None, 40, 1)] * 2
    monkeypatch.setattr(kb, "TILE", (7, 9))
    more = asked.union(spark.createDataFrame([("Bo Ek", None)], asked.schema))
    for method in ("basename", "name"):
        found = kb.candidate_list(base, more, method, 0).select("surface", "year", "entity_id", "rank").collect()
        assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_all_pairs_take_little_disk(spark, tmp_path):
    """500,000 pairs of 50 names: files encode runs and repeats, less than a byte a pair."""
    rows = [(i * 997, i, f"Ann {i % 50}〈{i}〉", "", "p", str(i), "", 1900, 1950, "ja", None, None, []) for i in range(5000)]
    keys = spark.createDataFrame([(f"Ann {i % 50}({i})", None) for i in range(5000)], "surface string, year int")
    found = kb.candidate_list(kb.KnowledgeBase.of(spark.createDataFrame(rows, kb.ENTITY)), keys, "basename", 0)
    found.select("surface", "entity_id", "rank").write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 500_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 500_000


def test_similar_once_a_form(spark, monkeypatch):
    """Digits that no title has are one form; ratios are those of the whole surface."""
    rows = [(i, i, t, "", "p", None, "", None, None, "en", None, None, []) for i, t in enumerate(["ann lee", "anna lee", "bo ek"] * 5)]
    base = kb.KnowledgeBase.of(spark.createDataFrame(rows, kb.ENTITY))
    surfaces = [f"ann lee {i}" for i in range(10, 40)] + ["bo e", "anna-lee", "zz"]
    asked = spark.createDataFrame([(s, None) for s in surfaces], "surface string, year int")
    real, seen = kb.similar_keys, []
    monkeypatch.setattr(kb, "similar_keys", lambda s, *a, **b: (seen.append(s.count()), real(s, *a, **b))[1])
    found = kb.candidate_list(base, asked, "fuzzy", 7).collect()
    assert seen == [4]
    for s in surfaces:
        near = sorted(((difflib.SequenceMatcher(None, k, s).ratio(), k) for k in ("ann lee", "anna lee", "bo ek")), reverse=True)
        want = [i for r, k in near if r >= kb.FUZZY for i, *_ in rows if rows[i][2] == k][:7]
        assert [r.entity_id for r in sorted(found, key=lambda r: r["rank"]) if r.surface == s] == want


def test_dense_memory_is_bounded():
    """Products of many queries with a large batch go by tiles; the result is that of all at once."""
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(3000, 8)), rng.normal(size=(5000, 8))
    sent = type("Sent", (), {"value": (np.arange(3000), q)})
    tracemalloc.start()
    found = next(candidates._nearest(sent, 4)(iter([pd.DataFrame({"vec_id": np.arange(5000) + 1500, "embedding": list(v)})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    every = np.round(q @ v.T, 5)
    every[np.arange(1500, 3000), np.arange(1500)] = -np.inf
    want = np.argsort(-every, axis=1, kind="stable")[:, :4] + 1500
    assert [set(x) for x in want] == list(found.groupby("query_id")["vec_id"].agg(set))


def test_beams_of_one_node_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPLIT", 10)
    tree = trie.written(trie.children(spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["d"],)], "tokens array<string>")))
    live = trie.written(spark.createDataFrame([(f"q{i}", "" if i else "d") for i in range(200)], "query string, node string"))
    met = trie._met(live, tree)
    assert sorted(map(tuple, met.select("query", "node", "token").collect())) == sorted(map(tuple, live.join(tree, "node").select("query", "node", "token").collect()))
    most = met.groupBy("node", "part").agg(F.count_distinct("query").alias("n")).agg(F.max("n")).first()[0]
    assert most < 40


def test_identities_send_nothing(spark, monkeypatch):
    """No round broadcasts its labels, however small their files."""
    plans, real = [], canon.written
    monkeypatch.setattr(canon, "written", lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()), real(d))[1])
    e = canon.written(spark.createDataFrame([(i, str(i // 2), str((i + 1) // 2)) for i in range(20)], "entity_id long, a string, b string"))
    found = canon.canon_map(e, [F.col("a"), F.col("b")])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.canon_id for r in found.collect()} == {0}
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_a_surface_is_one_row_whatever_its_years(spark, monkeypatch, base):
    """No table that is written on the way has a row for each year of a surface; each key is found as before."""
    every = [None, -70, -64, -1, 0, 63, 64, 1900, 1919, 1920, 1921, 1950, 1951]
    keys = spark.createDataFrame([(f"Ann Lee〈{i}〉", y) for i in range(50) for y in every] * 2, "surface string, year int")
    seen, real = [], kb.written
    monkeypatch.setattr(kb, "written", lambda d: (seen.append(d.count()), real(d))[1])
    found = kb.gather(base, keys).select("surface", "year", "entity_id", "score", "rank").collect()
    assert max(seen) <= 50
    assert len(found) == 50 * len(every) * 30
    for y in every:
        assert sorted((r.entity_id, r.rank) for r in found if r.surface == "Ann Lee〈7〉" and r.year == y) == [(i, i + 1) for i in range(30)]
        assert {r.score for r in found if r.year == y} == {0 if y is None else 3 if 1900 <= y <= 1950 else 1 if y == 1951 else -1}, y


def test_writes_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}
    before = names()
    canon.written(spark.range(10_000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id")))
    for _ in range(50):
        if names() <= before:
            break
        time.sleep(0.1)
    assert names() <= before
