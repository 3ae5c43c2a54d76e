"""Readers and numbers give the same rows whatever the size of the blocks that files are read by."""

import random

import pytest
from pyspark.sql import functions as F

from nomena.operators import numbering, tokens
from nomena.sources import readers

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k, None) for k in KEYS}
    spark.conf.set(KEYS[0], "1024")
    spark.conf.set(KEYS[1], "1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def token_file(n: int) -> str:
    rng = random.Random(n)
    out = ["TOKEN\tNE-COARSE-LIT\tNE-COARSE-METO\tNE-FINE-LIT\tNE-FINE-METO\tNE-FINE-COMP\tNE-NESTED\tNEL-LIT\tNEL-METO\tMISC"]
    for doc in range(n):
        out += [f"# hipe2022:document_id = d{doc}", f"# hipe2022:date = 19{doc:02}-01-02"]
        for _ in range(rng.randint(0, 60)):
            q = rng.choice(["_", "_", f"Q{rng.randint(1, 9)}"])
            out.append("\t".join([rng.choice(["New", "York", "été", ",", "x" * 30]), "O" if q == "_" else rng.choice(["B-loc", "I-loc"]), "_", "O", "_", "_", "_", q, "_", rng.choice(["_", "NoSpaceAfter"])]))
        out.append("")
    return "\n".join(out) + "\n"


def test_token_documents_by_blocks(spark, tmp_path, small_blocks):
    for i in (7, 25):
        (tmp_path / f"{i}.tsv").write_text(token_file(i))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = lambda: sorted(map(str, tokens.read_documents(spark, str(tmp_path)).select("file", "ord", F.map_entries("facts"), "tokens").collect()))
    flat = lambda: sorted(map(tuple, readers.read_tokens(spark, str(tmp_path)).collect()))
    lines = lambda: sorted(map(tuple, readers.read_lines(spark, str(tmp_path)).drop("block").collect()))
    small = rows(), flat(), lines()
    spark.conf.set(KEYS[0], "128m")
    assert small == (rows(), flat(), lines())
    for i in (7, 25):
        own = [(n, v) for f, n, v in small[2] if f.endswith(f"/{i}.tsv")]
        assert own == list(enumerate(token_file(i).split("\n")[:-1]))
    # by hand: the document of each token is the last one opened before it
    want, doc = [], None
    for n, line in enumerate(token_file(25).split("\n")):
        if line.startswith("# hipe2022:document_id"):
            doc = line.split(" = ")[1]
        elif "\t" in line and not line.startswith("TOKEN"):
            want.append((doc, n, line.split("\t")[0]))
    assert sorted((r[1:4] for r in small[1] if r[0].endswith("/25.tsv")), key=lambda r: r[1]) == want


def test_sentences_by_blocks(spark, tmp_path, small_blocks):
    text = "".join(f"# text = s {i}\n" + "".join(f"{j}\tw{j}\t_\t_\t_\t_\t_\t_\t_\t{'Entity=(e%d-person-1)|base_name=b' % j if j % 3 == 0 else '_'}\n" for j in range(1, 9)) + "\n" for i in range(60))
    (tmp_path / "a.conllu").write_text(text)
    got = sorted(tuple(r) for r in readers.read_conllu(spark, str(tmp_path / "a.conllu")).select("line_no", "sentence", "form", "entity_id").collect())
    want = [(i * 10 + j, f"s {i}", f"w{j}", f"e{j}") for i in range(60) for j in (3, 6)]
    assert got == want


def test_numbers_with_ties_and_empty(spark):
    d = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    got = [tuple(r) for r in numbering.numbered(d, [F.desc("k"), "id"], "n", 5).orderBy("n").collect()]
    assert got == [(k, i, 5 + n) for n, (k, i) in enumerate(sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1])))]
    assert numbering.numbered(d.limit(0), ["id"], "n").collect() == []
    tied = numbering.numbered(d.select("k"), ["k"], "n").collect()
    assert sorted(r["n"] for r in tied) == list(range(1000)) and [r["k"] for r in sorted(tied, key=lambda r: r["n"])] == sorted(i % 7 for i in range(1000))


def test_carried_over_empty_blocks(spark):
    rows = [("a", b, i, v) for b, i, v in ((0, 0, None), (0, 1, 3), (2, 0, None), (5, 0, None), (5, 1, 4), (9, 0, None))] + [("b", 1, 0, None), ("b", 3, 0, 8)]
    d = spark.createDataFrame(rows, "g string, b int, i int, v int")
    got = {(r["g"], r["b"], r["i"]): (r["c"], r["s"]) for r in numbering.running_sum(numbering.carried(d, ["g"], "b", "i", F.col("v"), "c"), ["g"], "b", "i", F.lit(1), "s").collect()}
    assert got == {("a", 0, 0): (None, 0), ("a", 0, 1): (3, 1), ("a", 2, 0): (3, 2), ("a", 5, 0): (3, 3), ("a", 5, 1): (4, 4), ("a", 9, 0): (4, 5), ("b", 1, 0): (None, 0), ("b", 3, 0): (8, 1)}
