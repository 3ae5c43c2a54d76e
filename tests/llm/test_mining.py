"""Substring dedup, hard negatives and collocations against brute force, and on awkward rows."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from nomena.llm import collocations, common, hard_negatives, substring_dedup
from test_operators import LOWER, ODD, WORD, frame, with_extras


def removed_by_hand(rows, least):
    """Words left of each row, given (doc_id, text)."""
    key = lambda d: substring_dedup.LAST if d is None else d
    first: dict = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - least + 1):
            first[tuple(w[i : i + least])] = min(key(d), first.get(tuple(w[i : i + least]), key(d)))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - least + 1):
            if first[tuple(w[i : i + least])] < key(d):
                gone.update(range(i, i + least))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_substrings(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab abc Abc é x1 the of".split())
    passages = [" ".join(rng.choice("k l m n o p q r s t u v".split()) for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 30))] + [rng.choice(passages)] * rng.randint(0, 3) + [word() for _ in range(9)])) for i in range(60)]
    rows += ODD + [(7, rows[3][1]), (7, rows[3][1]), (None, rows[3][1]), (-5, "\t".join(passages[0].split())), (99, "a " * 40), (98, "a " * 12), (-9, "a " * 13)]
    for least, seed in ((13, 8), (5, 3), (4, 4), (6, 1)):
        got = substring_dedup.dedup_substrings(frame(spark, rows), least=least, seed=seed).collect()
        assert order((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == order(removed_by_hand(rows, least))
    runs = {(d, tuple(w[i : i + 6])) for d, t in rows for w in [WORD.findall(t or "")] for i in range(len(w) - 5)}
    for r in got:  # some window of each repeat stands in its source
        assert all(any(s == x["source"] and (r["doc_id"], w) in runs for s, w in runs) for x in r["repeats"])


def test_substrings_with_odd_columns(spark):
    d = with_extras(frame(spark, [*ODD, (8, "word " * 20)])).withColumns({"n_words": F.lit("x"), "repeats": F.lit(1), "a": F.lit(1), "c": F.lit(2), "doc": F.lit(3), "__key": F.lit(4)}).drop("__key")
    got = substring_dedup.dedup_substrings(d)
    assert got.count() == len(ODD) + 1 and got.columns.count("n_words") == 1 and set(got.filter("doc_id = 8").first()["kept_text"].split()) == set()
    assert substring_dedup.dedup_substrings(d.limit(0)).collect() == []


def negatives_by_hand(rows, anchors, n_pos, n_neg, band):
    by: dict = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        v = (label, [int(np.floor(256 * float(np.float32(a)))) for a in x])
        by[i] = min(v, by.get(i, v))
    out = []
    dot = lambda p, q: sum(a * b for a, b in zip(p, q, strict=False))
    for a in sorted(i for i in by if anchors(i)):
        s = sorted((-dot(by[a][1], by[i][1]), i) for i in by if i != a)
        for score, p in [(-m, i) for m, i in s if by[i][0] == by[a][0]][:n_pos]:
            fits = [(-m, i) for m, i in s if by[i][0] != by[a][0] and band[0] * score <= -100 * m <= band[1] * score][:n_neg]
            out += [(a, p, r, i, score, m) for r, (m, i) in enumerate(fits, 1)]
    return out


def test_hard_negatives(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(700)]
    rows += [(1000 + i, i % 4, [1.0, 0.5, 0.0, 0.0, -1.0, 2.0]) for i in range(400)]  # one hot vector
    rows += [(2000, None, [1.0] * 6), (2001, 1, None), (None, 1, [1.0] * 6), (2002, 1, [1.0, None]), (2003, 1, [float("nan")] * 6), (2004, 1, [float("inf")] * 6), (2005, 1, []), (2006, 2, [3.0, 1.0]), (0, 9, [0.0] * 6), (2010, 77, [9.0] * 6)]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"qid": F.lit(1), "band": F.lit("x"), "score": F.lit(2), "cell": F.lit(1)})
    v = hard_negatives.whole_vectors(d)
    got = hard_negatives.hard_negatives(v, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = negatives_by_hand(rows, lambda i: i % 10 == 0, 5, 3, (50, 95))
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)
    got = hard_negatives.hard_negatives(v, F.col("vec_id") % 50 == 0, 2, 4, (20, 99))
    assert sorted(map(tuple, got.collect())) == sorted(negatives_by_hand(rows, lambda i: i % 50 == 0, 2, 4, (20, 99)))
    assert hard_negatives.hard_negatives(v.limit(0), F.lit(True)).collect() == []
    assert hard_negatives.hard_negatives(v.filter("vec_id = 2010"), F.lit(True)).collect() == []


def test_long_products():
    q = np.array([[1 << 40, -3]], np.int64)
    assert hard_negatives._products(q, np.array([[1 << 22, 5], [7, 1]], np.int64)).tolist() == [[(1 << 62) - 15, 7 * (1 << 40) - 3]]


def phrases_by_hand(rows, longest, least, subsumed):
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = Counter({k: v for k, v in f.items() if v >= least})
    out = []
    for (lang, g), a in f.items():
        if len(g) > 1:
            score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            part = any(x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= subsumed * a for (x, h), b in f.items())
            out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score, part))
    return sorted(out)


def test_collocations(spark):
    rng = random.Random(8)
    vocabulary = "new york city of the Of a É x-1 <b>".split()
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",,", " ; "]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und"]), text(rng.randint(0, 60))) for _ in range(80)] + [("en", None), ("en", ""), ("xx", " .,\n"), ("fr", "new york city of the " * 500), ("de", "one two three four five six " * 30)]
    d = spark.createDataFrame(rows, "lang string, text string").withColumns({"block": F.lit(1), "id": F.lit("x"), "word": F.lit(0)})
    for longest, least, subsumed, block in ((5, 20, 100, 1 << 20), (4, 5, 60, 300), (2, 9, 100, 50)):
        got = collocations.collocations(d, longest, least, subsumed, block).collect()
        assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, longest, least, subsumed)
        got = collocations.collocations(d, longest, least, subsumed, block, sent=0).collect()  # numbers by a join
        assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, longest, least, subsumed)
    assert collocations.collocations(d.limit(0)).collect() == []
    assert collocations.collocations(d, least=10**6).collect() == []


def test_best_phrases_have_ties(spark):
    rows = [("en", f"p{i % 7} q", 100 + i % 3, 1, 1, 9, i % 2, False) for i in range(40)]
    d = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long, part boolean").distinct()
    got = [(r["rank"], r["score"], r["a"], r["phrase"]) for r in collocations.best(d, 5).orderBy("rank").collect()]
    want = sorted({(-r[6], -r[2], r[1]) for r in rows})[:5]
    assert got == [(i, -s, -a, p) for i, (s, a, p) in enumerate(want, 1)]


def test_scopes_are_per_thread(spark):
    """A scope of one thread neither takes nor deletes what another one writes."""
    import threading

    kept: list = []
    with common.scratch(spark):
        t = threading.Thread(target=lambda: kept.append(common.materialize(spark.range(3))))
        t.start()
        t.join()
    assert kept[0].count() == 3


def test_html_by_whole_addresses(spark):
    """Pages told apart by parameters, or by nothing but their id: template goes from all of them, whatever the size of the host."""
    page = lambda i: f"<body><div>Site of things</div><p>Own text number {i}, {'ab' * (i % 7)}.</p><div>All rights kept</div></body>"
    rows = [(i, f"http://a.org/view.php?id={i}&x=1#top", page(i)) for i in range(6)] + [(100 + i, None, page(i)) for i in range(6)] + [(200 + i, f"http://b.org/view.php?x=1&id={i}", page(i)) for i in range(300)] + [(900 + i, "", page(i)) for i in range(3)]
    from nomena.llm import html_extract

    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        assert got[i] == html_extract.blocks(h)[1][1], i


def test_collocations_read_blocks_a_few_at_once(spark, monkeypatch):
    """A row of the tables of blocks holds megabytes; few words are sent to the tasks; both ways come to the same."""
    from nomena.llm import collocations as c

    docs = spark.createDataFrame([("en", "a b c d a b c. a b")] * 120, "lang string, text string")
    plain = sorted(map(tuple, c.collocations(docs).collect()))
    seen, real = [], c.materialize
    monkeypatch.setattr(c, "materialize", lambda d, keep=False: (seen.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))), real(d, keep))[1])
    monkeypatch.setattr(c, "SENT_WORDS", 1)
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: (sent.append(x), broadcast(self, x))[1])
    assert sorted(map(tuple, c.collocations(docs).collect())) == plain
    assert seen[0] == 4096 and min(seen[1:5]) == max(seen[1:5]) == 16
    assert not [x for x in sent if isinstance(x, c._Numbers) and x.words is not None]
