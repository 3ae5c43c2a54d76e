import json

import pytest

from nomena.sources import readers, sinks


def test_jsonl_round_trip(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("".join(json.dumps({"mention": f"團{i}", "year": i}, ensure_ascii=False) + "\n" for i in range(500)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several blocks
    try:
        d = readers.read_jsonl(spark, str(f), "mention string, year int")
        assert [(r.sample_idx, r.mention, r.year) for r in d.orderBy("sample_idx").collect()] == [(i, f"團{i}", i) for i in range(500)]
        sinks.write_jsonl(d, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert lines == [json.dumps({"mention": f"團{i}", "year": i}, ensure_ascii=False, separators=(",", ":")) for i in range(500)]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "mention string").columns == ["sample_idx", "mention"]


def test_tokens_conllu_run(spark, tmp_path):
    row = lambda *f: "\t".join(f)
    t = tmp_path / "t.tsv"
    t.write_text("\n".join([row("TOKEN", *["X"] * 9), "# hipe2022:document_id = d1", row("Paris", "B-loc", *["_"] * 5, "Q90", "_", "NoSpaceAfter"), row(",", "O", *["_"] * 8), "short\tO", "# hipe2022:document_id = d2", row("x", "O", *["_"] * 8)]))
    got = readers.read_tokens(spark, str(t)).orderBy("line_no").select("document_id", "token", "ner", "nel", "no_space").collect()
    assert [tuple(r) for r in got] == [("d1", "Paris", "B-loc", "Q90", True), ("d1", ",", "O", "_", False), ("d2", "x", "O", "_", False)]
    c = tmp_path / "c.conllu"
    c.write_text("# text = a b\n" + row("1", "a", *["_"] * 7, "Entity=(e12-person-1|base_name=arjuna") + "\n" + row("2", "b", *["_"] * 8) + "\n\n# text = c\n" + row("1", "c", *["_"] * 7, "Entity=(e3-place)"))
    got = readers.read_conllu(spark, str(c)).orderBy("line_no").select("sentence", "form", "entity_id", "type", "base_name").collect()
    assert [tuple(r) for r in got] == [("a b", "a", "e12", "person", "arjuna"), ("c", "c", "e3", "place", None)]
    r = tmp_path / "r.run"
    r.write_text("7 Q0 d3 1 0.5 tag\nbad line\n")
    assert [tuple(x) for x in readers.read_run(spark, str(r)).collect()] == [("7", "d3", 1, 0.5)]


def test_annotations(spark, tmp_path):
    text = "keyword,parent_keyword,start,end,category\n 市川団十郎 ,,3,x,役者\n"
    for name, encoding in (("a.csv", "shift-jis"), ("b.csv", "euc-jp")):
        (tmp_path / name).write_bytes(text.encode(encoding))
    got = readers.read_annotations(spark, str(tmp_path)).filter("file LIKE '%a.csv'").select("mention", "parent_name", "start", "end", "category").collect()
    assert [tuple(r) for r in got] == [("市川団十郎", "市川団十郎", 3, 0, "役者")]


def test_markdown(spark):
    d = spark.createDataFrame([("a|b", 1), (None, 2)], "m string, n int")
    assert sinks.markdown(d) == "| m | n |\n| --- | --- |\n| a\\|b | 1 |\n|  | 2 |"
    with pytest.raises(ValueError):
        sinks.markdown(d, 1)


def test_broken_lines_are_errors(spark, tmp_path):
    from pyspark.errors import SparkRuntimeException

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(SparkRuntimeException, match="no JSON in line 2"):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
