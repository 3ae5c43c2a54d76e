"""Stores that grow and exports that go on where they were stopped."""

import json

import pytest
from pyspark.sql import functions as F

import stated_rows as rows
from nomena.operators import kb
from nomena.operators.candidate_cache import CandidateCache
from nomena.sources.export import export_ranges

ASKED = "surface string, year int, context_left string, context_right string"


def test_cache_computes_only_what_is_missing(spark, tmp_path):
    base = kb.KnowledgeBase.of(rows.base_frame(spark))
    calls = []

    def find(keys):
        calls.append(sorted(map(str, keys.collect())))
        return kb.candidate_list(base, keys, "gather", 3)

    asked = [("市川団十郎", 1710, "a", "b"), ("市川団十郎", 1710, "a", "b"), ("無名", None, None, ""), (None, 1, "", "")]
    m = spark.createDataFrame(asked, ASKED)
    cache = CandidateCache(spark, str(tmp_path), "x__gather")
    assert cache.rows().isEmpty()
    assert cache.fill(m, find) == 3 and cache.versions() == [1]
    assert cache.fill(m, find) == 0 and len(calls) == 1
    more = spark.createDataFrame([*asked, ("市川海老蔵", 1740, "a", "b"), ("市川団十郎", 1710, "other", "b")], ASKED)
    assert cache.fill(more, find) == 2 and cache.versions() == [1, 2]
    assert len(calls[1]) == 2 and all("1740" in x or "1710" in x for x in calls[1])
    want = {tuple(r) for r in kb.candidate_list(base, more.select("surface", "year").distinct(), "gather", 3).select("surface", "year", "entity_id", "rank").collect()}
    got = cache.candidates(more).select("surface", "year", "entity_id", "rank").collect()
    assert {tuple(r) for r in got} == want and len(got) == sum(1 for a in [*asked, ("市川海老蔵", 1740), ("市川団十郎", 1710)] for w in want if (a[0], a[1]) == w[:2])
    assert cache.candidates(more, 1).filter("rank > 1").isEmpty()


def test_a_failed_fill_leaves_the_cache(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, "", "")], ASKED)
    cache = CandidateCache(spark, str(tmp_path), "x")
    with pytest.raises(RuntimeError):
        cache.fill(m, lambda keys: (_ for _ in ()).throw(RuntimeError("stopped")))
    assert cache.versions() == [] and cache.rows().isEmpty()
    assert cache.fill(m, lambda keys: keys.select("surface", "year", F.lit(5).alias("entity_id"), F.lit(1).alias("rank"))) == 1


def whole(path):
    return [(p.name, f.name, f.read_bytes()) for p in sorted(path.iterdir()) if p.is_dir() for f in sorted(p.iterdir()) if f.suffix == ".json"]


def test_export_goes_on(spark, tmp_path):
    d = spark.range(950).select((999 - F.col("id")).alias("sample_idx"), F.struct(F.col("id").alias("a"), F.array("id", "id").alias("b")).alias("nested"))
    manifest = export_ranges(d, str(tmp_path / "one"), "sample_idx", 100)
    assert manifest["rows"] == 950 and json.loads((tmp_path / "one" / "manifest.json").read_text()) == manifest
    one = whole(tmp_path / "one")
    lines = [json.loads(x) for _, _, b in one for x in b.decode().splitlines()]
    assert [x["sample_idx"] for x in lines] == list(range(50, 1000))
    again = tmp_path / "two"
    export_ranges(d.filter("sample_idx < 300"), str(again), "sample_idx", 100)  # stopped after three parts
    (again / "manifest.json").unlink()
    parts = sorted(p for p in again.iterdir() if p.is_dir())
    half = parts[-1]
    (half / "_SUCCESS").unlink()  # one of them was not whole
    for f in half.glob("*.json"):
        f.write_text("broken")
    kept = {p.name: p.stat().st_mtime_ns for p in parts[:-1]}
    assert export_ranges(d, str(again), "sample_idx", 100) == manifest and whole(again) == one
    assert all((again / n).stat().st_mtime_ns == t for n, t in kept.items())
